"""Streaming.

The reference is batch only: it has no streams, watermarks or state. Nothing here adds
streaming operators. What carries over is that every fitted transform of this library is
a projection of literals (``PrepModel.transform``, ``engineer``, a fitted MLlib
``PipelineModel``), so the same fitted objects apply unchanged to a DataFrame from
``spark.readStream`` (see ``tests/test_prep.py::test_prep_on_stream``).
"""
