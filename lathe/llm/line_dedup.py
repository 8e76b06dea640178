"""Line deduplication by a log-template tree of fixed depth, in DataFrame functions only.

1. A line's words that hold a digit are variable fields and become ``<*>``. The masked line goes
   down the tree by its word count and its ``depth`` leading words to a leaf.
2. A leaf generalises its lines: at each further position the word that most of the leaf's
   documents have is constant if more than half of them have it, any other position is a
   variable field. If more than half of the positions are constant, that is the leaf's template,
   and the lines that agree with ``AGREE`` of its constants belong to it (``Posted by Alice in
   News`` and ``Posted by Bob in Sport``). Every other masked line is a template of its own.
3. A template that ``min_docs`` documents have recurs; its lines are dropped, but for the first
   line of the smallest document that has it (so each text survives once).

Lines leave their document as two 64-bit hashes (tree path, masked line) and their position;
both must agree. Equal lines of a document are combined, spread by document, and then counted
per template with partial sums, so a line that a third of all documents have is a few rows of
a task. Words are looked at in leaves of several masked lines and ``min_docs``
documents only, once for each masked line. Texts move to show those lines, and to meet the
positions of their dropped lines.

Edge cases: a null text stays null, an empty one empty; lines are split at ``\\n``; a line of
white space has no words and is never dropped; white space inside a line doesn't tell lines
apart; rows with equal id and text are one document, and are treated alike; a null id counts
as larger than any other. If all lines of a text are dropped, it is empty. Ties between words of
a position go to the smaller one; with more than half, none can tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.scratch import written

#: Documents from which on a template recurs, and leading words in the tree.
MIN_DOCS = 5
DEPTH = 2
#: Share of a leaf's constants that a line of its template has.
AGREE = 0.9
#: A key with more than this share of the rows (and more rows than ``PART_ROWS``) is dealt to parts.
HOT_SHARE = 0.001
PART_ROWS = 10_000

_SPACE = r"[\x09-\x0D\x20]"
_FIELD = r"[^\x09-\x0D\x20]*[0-9][^\x09-\x0D\x20]*"
#: The same words, found without going back: from a word's start, past what is no digit.
_FIELD_JAVA = r"(?<![^\x09-\x0D\x20])[^\x09-\x0D\x200-9]*+[0-9][^\x09-\x0D\x20]*+"
_LAST = 2**63 - 1


def template(line: Column) -> Column:
    """The line with one space between words and ``<*>`` for variable fields."""
    odd = F.lit(False)
    for mark in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(mark))
    spaced = F.trim(F.when(odd, F.regexp_replace(line, _SPACE + "+", " ")).otherwise(line))
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, _FIELD_JAVA, "<*>")).otherwise(spaced)


def _path(masked: Column, depth: int) -> Column:
    """The way down the tree: word count and leading words."""
    count = F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit("")))
    return F.xxhash64(count, F.substring_index(masked, " ", depth))


def _dealt(rows: DataFrame, table: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Inner join of ``rows`` with the one row of ``table`` that has their keys, which says how many
    ``_rows`` there are. Those of a hot key are dealt by ``spread`` to parts, and the row of
    ``table`` goes to each of them; ``1 / HOT_SHARE`` keys at most are hot, so these are broadcast."""
    total = table.agg(F.sum("_rows")).first()[0] or 0
    parts = F.ceil(F.col("_rows") / max(PART_ROWS, total * HOT_SHARE)).cast("int")
    hot = F.broadcast(table.where(parts > 1).select(*keys, parts.alias("_parts")))
    salt = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_parts")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("_rows")
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def _generalised(rows: DataFrame, text: str, counted: DataFrame, min_docs: int, depth: int) -> DataFrame:
    """The masked lines that belong to their leaf's template: ``_h1``, ``_h2``, ``_rows``."""
    leaves = counted.groupBy("_h1").agg(F.count("*").alias("_rows"), F.sum("_n").alias("_docs")).where((F.col("_rows") > 1) & (F.col("_docs") >= min_docs))
    members = _dealt(counted, leaves.withColumn("_k", F.col("_rows")), ["_h1"], "_h2")
    # a document shows the masked lines that it is the first to have
    lines = F.collect_list(F.struct("_h1", "_h2", "_n", "_docs", "_k", F.col("_first._pos").alias("_at"))).alias("_lines")
    owners = members.groupBy(F.col("_first.__ld_doc").alias("__ld_doc"), F.col("_first.__ld_th").alias("__ld_th")).agg(lines)
    shown = rows.select("__ld_doc", "__ld_th", F.split(F.col(text), "\n").alias("_split")).join(owners, ["__ld_doc", "__ld_th"])
    words = F.transform("_lines", lambda x: F.struct(x["_h1"].alias("_h1"), x["_h2"].alias("_h2"), x["_n"].alias("_n"), x["_docs"].alias("_docs"), x["_k"].alias("_k"),
                                                     F.split(template(F.get("_split", x["_at"])), " ").alias("_words")))
    shown = written(shown.select(F.explode(words).alias("_l")).select("_l.*").dropDuplicates(["_h1", "_h2"]), "shown")

    size = F.size("_words")
    cells = shown.select("_h1", "_n", "_docs", "_k", size.alias("_size"), F.posexplode("_words").alias("_pos", "_word")).where(F.col("_pos") >= depth)
    common = cells.groupBy("_h1", "_pos", "_word", "_docs", "_k", "_size").agg(F.sum("_n").alias("_n")).where(2 * F.col("_n") > F.col("_docs"))
    leaf = common.groupBy("_h1", "_k", "_size").agg(F.collect_list(F.struct("_pos", "_word")).alias("_constants"))
    leaf = leaf.where(2 * (F.size("_constants") + depth) > F.col("_size")).select("_h1", "_constants", F.col("_k").alias("_rows"))
    own = _dealt(shown, written(leaf, "leaves"), ["_h1"], "_h2")
    same = F.size(F.filter("_constants", lambda c: F.get("_words", c["_pos"]) == c["_word"]))
    return own.where(same >= AGREE * F.size("_constants")).select("_h1", "_h2", F.col("_n").alias("_rows"))


def drop_recurring(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """The input rows with ``text`` less its recurring lines, ``n_lines`` and ``n_dropped``.

    Other columns are kept; ``n_lines`` and ``n_dropped`` (long) replace columns so named.
    """
    rows = documents.withColumns({"__ld_doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), "__ld_th": F.xxhash64(F.col(text))})
    lines = rows.select("__ld_doc", "__ld_th", F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "_line"))
    masked = lines.select("__ld_doc", "__ld_th", "_pos", template(F.col("_line")).alias("_m")).where("_m <> ''")
    lines = written(masked.select("__ld_doc", "__ld_th", "_pos", _path(F.col("_m"), depth).alias("_h1"), F.xxhash64("_m").alias("_h2")), "lines")

    place = F.struct("__ld_doc", "__ld_th", "_pos")
    once = lines.groupBy("__ld_doc", "__ld_th", "_h1", "_h2").agg(F.min("_pos").alias("_pos"))
    counted = written(once.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.min(place).alias("_first")), "masked")
    general = written(_generalised(rows, text, counted, min_docs, depth), "general")

    # lines of a leaf's template: their documents are counted together
    seen = _dealt(lines, general, ["_h1", "_h2"], "__ld_doc").groupBy("_h1", "__ld_doc", "__ld_th").agg(F.min("_pos").alias("_pos"))
    leaf = seen.groupBy("_h1").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where(F.col("_n") >= min_docs)
    held = general.groupBy("_h1").agg(F.count("*").alias("_held"))
    leaf = written(leaf.join(held, "_h1").select("_h1", "_first", F.col("_held").alias("_rows")), "recurring")
    kinds = _dealt(general.withColumnRenamed("_rows", "_n"), leaf, ["_h1"], "_h2").select("_h1", "_h2", "_first", F.col("_n").alias("_rows"))
    alone = counted.where(F.col("_n") >= min_docs).join(general.select("_h1", "_h2"), ["_h1", "_h2"], "left_anti")
    alone = alone.select("_h1", "_h2", "_first", F.col("_n").alias("_rows"))
    met = _dealt(lines, written(kinds.unionByName(alone), "templates"), ["_h1", "_h2"], "__ld_doc").where(F.col("_first") != place)
    drops = met.groupBy("__ld_doc", "__ld_th").agg(F.collect_set("_pos").alias("__ld_drop"))

    joined = rows.drop("n_lines", "n_dropped").join(drops, ["__ld_doc", "__ld_th"], "left")
    split = F.split(F.col(text), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__ld_drop")), lambda i: F.get(split, i))
    counts = joined.withColumns({
        "n_lines": F.coalesce(F.size(split).cast("long"), F.lit(0).cast("long")),
        "n_dropped": F.coalesce(F.size("__ld_drop").cast("long"), F.lit(0).cast("long")),
        text: F.when(F.col("__ld_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
    })
    rest = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    return counts.select(*rest, "n_lines", "n_dropped")


def drop_recurring_sql(min_docs: int = MIN_DOCS, depth: int = DEPTH) -> str:
    """DuckDB SQL: doc_id, text, n_lines, n_dropped for ``documents``."""
    return f"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {_LAST}) AS d, text FROM documents),
    lines AS (
      SELECT r, d, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
      FROM docs),
    masked AS (
      SELECT r, d, text, pos, line,
        regexp_replace(trim(regexp_replace(line, '{_SPACE}+', ' ', 'g'), ' '), '{_FIELD}', '<*>', 'g') AS m
      FROM lines),
    counted AS (
      SELECT m, string_split(m, ' ') AS w, len(string_split(m, ' ')) AS size, string_split(m, ' ')[1:{depth}] AS head, count(DISTINCT (d, text)) AS n
      FROM masked WHERE m <> '' GROUP BY m),
    leaves AS (SELECT size, head, sum(n) AS docs FROM counted GROUP BY size, head HAVING count(*) > 1 AND sum(n) >= {min_docs}),
    cells AS (
      SELECT size, head, n, docs, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM counted JOIN leaves USING (size, head)),
    constants AS (
      SELECT size, head, place, word FROM cells WHERE place > {depth} GROUP BY size, head, docs, place, word HAVING 2 * sum(n) > docs),
    known AS (
      SELECT size, head, list({{'place': place, 'word': word}}) AS c FROM constants GROUP BY size, head HAVING 2 * (count(*) + {depth}) > size),
    general AS (
      SELECT m, size, head FROM counted JOIN known USING (size, head)
      WHERE len(list_filter(c, lambda x: w[x.place] = x.word)) >= {AGREE} * len(c)),
    named AS (
      SELECT masked.*, CASE WHEN g.m IS NULL THEN masked.m ELSE 'leaf ' || g.size || ' ' || array_to_string(g.head, ' ') END AS t, g.m IS NOT NULL AS leaf
      FROM masked LEFT JOIN general g ON g.m = masked.m),
    per_doc AS (SELECT t, leaf, d, text FROM named WHERE m <> '' GROUP BY ALL),
    recurring AS (SELECT t, leaf, min((d, text)) AS first, min(d) AS low FROM per_doc GROUP BY t, leaf HAVING count(*) >= {min_docs}),
    judged AS (
      SELECT r, pos, line, x.t IS NOT NULL AND (d > low
        OR row_number() OVER (PARTITION BY r, named.t, named.leaf ORDER BY pos) > 1) AS dropped
      FROM named LEFT JOIN recurring x ON x.t = named.t AND x.leaf = named.leaf AND m <> ''),
    built AS (
      SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped) AS kept, count(*) AS n, count(*) FILTER (dropped) AS k
      FROM judged GROUP BY r)
    SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n, 0) AS n_lines, coalesce(k, 0) AS n_dropped
    FROM docs LEFT JOIN built USING (r)
    """
