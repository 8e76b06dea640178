"""Repair of conversation structure by the cheapest edits, streamed over secondary-sorted rows.

A conversation is sound when the initials of its roles are ``(s?(ua)+)?``. Edits: Keep (0, if
the role fits), Rerole to user or assistant (3), Delete (4; the only edit for blank and
duplicate rows), Insert an empty user or assistant turn (3); a truncated row that stays costs 3.
The cheapest edits are taken, of equally cheap ones those with the ASCII-least initials.

1. Equal rows of a turn are one row with a count, so repeats are combined before any shuffle.
   A row is the first of its role and text if its turn is the least of theirs; such keys are
   joined with the rows on the whole key, which no two rows share.
2. Rows that may stay (without their texts) are repartitioned by conversation and sorted by turn,
   last first. ``mapInPandas`` carries the costs from each of four states to the end across
   Arrow batches; for each row it leaves one byte, the edit to take in each state. Bytes are
   put out in blocks of ``BLOCK`` rows, so a giant conversation holds one block in memory.
3. Rows with texts, the keys of first rows and the blocks, each ahead of its row, are sorted
   first turn first, so that texts are never joined. A
   second ``mapInPandas`` follows the edits from the start state and carries the state, the
   running digest and the audit.

The row order is: turn (nulls first), role, SHA-256 of the text. A digest over whole
conversations is sequential, so a conversation is one task's stream, at one byte of audit a row.

Edge cases: a null role or text is one space; a role that is empty or starts otherwise than with
s, u or a can't be kept; repeated rows are repeats (all but the first are duplicates); a null
conversation id is a conversation of its own; no rows: zeros, an empty audit, the digest of the
empty string, for ids given in ``every``; gaps beyond 64 bits are 2^63 - 1; an empty table gives
an empty result. Only the four named columns are read, so that other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.scratch import small_batches, written

#: Rows (bytes) of a block of edits.
BLOCK = 65_536

_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_MADE = (2, 2, 3, 2)  # by an inserted or reroled turn: an assistant after a user, else a user
_ROLE = ("user", "user", "assistant", "user")
_LETTERS = "DIKR"  # in ASCII order
_END = (0, 6, 3, 0)
_INITIALS = "sua"
_LEGAL = {"su", "ua", "au"}
_KEY = ["conv", "turned", "turn", "role", "digest"]


@lru_cache(maxsize=4096)
def _back(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """Costs to the end from each state before a row, and the edits to take (two bits a state)."""
    initial, late = (_INITIALS + "-")[code // 2], 3 * (code % 2)
    options = []
    for s in range(4):
        kept = _KEPT.get((s, initial))
        options.append({"D": after[s] + 4, "K": after[kept] + late if kept else 10**9, "R": after[_MADE[s]] + 3 + late})
    cost = [min(o.values()) for o in options]
    for _ in range(3):
        cost = [min(cost[s], 3 + cost[_MADE[s]]) for s in range(4)]
    edits = 0
    for s in range(4):
        options[s]["I"] = 3 + cost[_MADE[s]]
        edits |= next(i for i, letter in enumerate(_LETTERS) if options[s][letter] == cost[s]) << (2 * s)
    least = min(cost)
    return tuple(c - least for c in cost), edits


def _edit_blocks(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Rows last first -> blocks of edits, each with the key of its first row."""
    conv, after, edits, key = None, _END, bytearray(), None
    for batch in batches:
        out = []
        for row in zip(*(batch[c].tolist() for c in (*_KEY, "code")), strict=True):
            if row[0] != conv or len(edits) == block:
                if edits:
                    out.append((*key, bytes(reversed(edits))))
                    edits.clear()
                if row[0] != conv:
                    conv, after = row[0], _END
            after, edit = _back(after, row[5])
            edits.append(edit)
            key = row[:5]
        if out:
            yield pd.DataFrame(out, columns=[*_KEY, "edits"])
    if edits:
        yield pd.DataFrame([(*key, bytes(reversed(edits)))], columns=[*_KEY, "edits"])


class _Conversation:
    """What the second pass carries from row to row."""

    def __init__(self, conv: str) -> None:
        self.conv, self.state, self.edits, self.at = conv, 0, b"", 0
        self.audit, self.sha, self.turns = bytearray(), hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.low = self.high = self.before = None
        self.distinct = 0
        self.first = False  # of the next row: no equal role and text came before

    def put(self, role: str, text: str) -> tuple[str, int, str, str]:
        self.sha.update(("\n" if self.turns else "").encode() + f"{role}:{text}".encode())
        self.turns += 1
        return self.conv, self.turns, role, text

    def deleted(self, n: int) -> None:
        self.audit += b"D" * n
        self.cost += 4 * n

    def inserted(self) -> tuple[str, int, str, str]:
        role = _ROLE[self.state]
        self.state = _MADE[self.state]
        self.audit += b"I"
        self.cost += 3
        return self.put(role, "")

    def row(self, turned: bool, turn: int, role: str, n: int, blank: bool, truncated: bool, text: str) -> list[tuple[str, int, str, str]]:
        if turned and turn != self.high:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.distinct += 1
        self.illegal += (self.before is not None and self.before + role[:1] not in _LEGAL) + n - 1
        self.before = role[:1]
        first, self.first = self.first, False
        if blank or not first:
            self.blank += n * blank
            self.duplicate += n * (not blank)
            self.deleted(n)
            return []
        self.duplicate += n - 1
        self.truncated += truncated
        out, edits = [], self.edits[self.at]
        self.at += 1
        while (letter := _LETTERS[edits >> (2 * self.state) & 3]) == "I":
            out.append(self.inserted())
        if letter == "D":
            self.deleted(1)
        else:
            self.audit += letter.encode()
            self.cost += 3 * truncated + 3 * (letter == "R")
            out.append(self.put(role if letter == "K" else _ROLE[self.state], text))
            self.state = _KEPT[self.state, role[:1]] if letter == "K" else _MADE[self.state]
        self.deleted(n - 1)
        return out

    def end(self) -> list[tuple[str, int, str, str]]:
        out = []
        while self.state in (1, 2):
            out.append(self.inserted())
        return out

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv, min(gaps, 2**63 - 1), self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


_SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv string, position long, role string, text string"


def _replay(batches: Iterator[pd.DataFrame], summaries: bool) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in (_SUMMARY if summaries else _TURNS).split(", ")]
    now = None

    def closed() -> list[tuple]:
        if now is None:
            return []
        turns = now.end()
        return [now.summary()] if summaries else turns

    for batch in batches:
        out: list[tuple] = []
        for conv, turned, turn, role, _, kind, edits, n, blank, truncated, text in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
            if now is None or conv != now.conv:
                out += closed()
                now = _Conversation(conv)
            if kind == 1:
                now.edits, now.at = edits, 0
            elif kind == 2:
                now.first = True
            elif kind == 3:
                turns = now.row(turned, turn, role, n, blank, truncated, text)
                if not summaries:
                    out += turns
        if out:
            yield pd.DataFrame(out, columns=columns)
    if out := closed():
        yield pd.DataFrame(out, columns=columns)


def turns_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The distinct rows of each turn: how often (``n``), and whether ``blank`` or ``truncated``.
    ``conv`` is ``+id``, ``-`` for null."""
    words = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    base = rows.select(
        F.coalesce(F.concat(F.lit("+"), F.col(conv_id).cast("string")), F.lit("-")).alias("conv"),
        F.col(turn).isNotNull().alias("turned"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.unhex(F.sha2(words, 256)).alias("digest"),
        words.alias("text"),
    )
    once = base.groupBy(*_KEY).agg(F.count("*").alias("n"), F.first("text").alias("text"))
    trimmed = F.rtrim("text", F.lit(_SPACES))
    late = (trimmed != "") & ~F.substring(trimmed, -1, 1).isin(".", "!", "?")
    return once.select(*_KEY, "n", (trimmed == "").alias("blank"), late.alias("truncated"), "text")


def first_of(turns: DataFrame) -> DataFrame:
    """The keys of the rows whose role and text no earlier turn of the conversation holds."""
    least = turns.groupBy("conv", "role", "digest").agg(F.min(F.struct("turned", "turn")).alias("least"))
    return least.select("conv", "least.turned", "least.turn", "role", "digest")


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    fit = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (2 * fit + F.col("truncated").cast("int")).alias("code")


def _streams(rows: DataFrame, every: DataFrame | None, names: tuple[str, str, str, str]) -> DataFrame:
    """Rows and blocks of edits in the order of the second pass."""
    small_batches(rows.sparkSession)
    turns = written(turns_of(rows, *names), "turns")
    first = written(first_of(turns), "first")
    live = turns.where(~F.col("blank")).select(*_KEY, _code()).join(first, _KEY)
    down = live.repartition("conv").sortWithinPartitions("conv", *[F.desc(c) for c in _KEY[1:]])
    blocks = written(down.mapInPandas(lambda batches: _edit_blocks(batches, BLOCK), "conv string, turned boolean, turn long, role string, digest binary, edits binary"), "edits")
    nothing = {"edits": F.lit(b""), "n": F.lit(0).cast("long"), "blank": F.lit(False), "truncated": F.lit(False), "text": F.lit("")}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        rest = [F.col(c) if c in df.columns else value.alias(c) for c, value in nothing.items()]
        return df.select(*_KEY, F.lit(kind).alias("kind"), *rest)

    both = shaped(blocks, 1).unionByName(shaped(first, 2)).unionByName(shaped(turns, 3))
    if every is not None:
        ids = every.select(F.coalesce(F.concat(F.lit("+"), F.col(names[0]).cast("string")), F.lit("-")).alias("conv")).distinct()
        ids = ids.select("conv", F.lit(False).alias("turned"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"))
        both = both.unionByName(shaped(ids, 0))
    return both.repartition("conv").sortWithinPartitions(*_KEY, "kind")


def _named(df: DataFrame, rows: DataFrame, conv_id: str) -> DataFrame:
    own = F.when(F.col("conv") != "-", F.expr("substring(conv, 2)")).cast(rows.schema[conv_id].dataType)
    return df.select(own.alias(conv_id), *[c for c in df.columns if c != "conv"])


def repair(rows: DataFrame, every: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation of ``rows`` (and id of ``every``): ``gaps`` between its turns,
    numbers of ``blank``, ``duplicate`` and ``truncated`` rows (first fault) and of ``illegal``
    neighbours, ``cost`` and ``audit`` of the edits, and the digest of the repaired text."""
    stream = _streams(rows, every, (conv_id, turn, role, text))
    return _named(stream.mapInPandas(lambda batches: _replay(batches, True), _SUMMARY), rows, conv_id)


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of the repaired conversations: id, ``position`` (from 1), ``role``, ``text``."""
    stream = _streams(rows, None, (conv_id, turn, role, text))
    return _named(stream.mapInPandas(lambda batches: _replay(batches, False), _TURNS), rows, conv_id)


def damage(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns with faults put in by ``crc32(id:turn) % 20``: 0 drops a row, 1 empties its
    text, 2 removes ``[.!?]``, 3 repeats it, 4 makes it a user's; nulls of the key, the role and
    the text are one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col(conv_id).cast("string"), space), F.coalesce(F.col(turn).cast("string"), space))
    words = F.coalesce(F.col(text).cast("string"), space)
    rows = table.select(conv_id, turn, F.coalesce(F.col(role).cast("string"), space).alias(role), words.alias(text), (F.crc32(key) % 20).alias("_fault"))
    fault = F.col("_fault")
    return rows.where(fault != 0).select(
        conv_id,
        turn,
        F.when(fault == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(fault == 1, "").when(fault == 2, F.translate(F.col(text), ".!?", "")).otherwise(F.col(text)).alias(text),
        F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def repair_sql() -> str:
    """``repair`` of the damaged table ``conversations``, by costs of prefixes."""
    visible = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS fault
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
), seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
faults AS (
  SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
         CASE WHEN NOT regexp_matches(text, '{visible}') THEN 'b' WHEN nth > 1 THEN 'd'
              WHEN regexp_extract(text, '({visible})[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM seen
), counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, sum(CAST(fault = 'b' AS INT)) AS blank,
         sum(CAST(fault = 'd' AS INT)) AS duplicate, sum(CAST(fault = 't' AS INT)) AS truncated,
         sum(CAST(pair NOT IN ('su', 'ua', 'au') AS INT)) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id
), edits(s, kind, t, cost, letter) AS (
  VALUES ('', 'u', 'u', 3, 'I'), ('s', 'u', 'u', 3, 'I'), ('a', 'u', 'u', 3, 'I'), ('u', 'a', 'a', 3, 'I')
), inserts AS (  -- 0 to 2 turns put in after a state
  SELECT DISTINCT s, s AS t, 0 AS cost, '' AS letters, '' AS added FROM (VALUES (''), ('s'), ('u'), ('a')) v(s)
  UNION ALL SELECT s, t, 3, 'I', CASE t WHEN 'u' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END FROM edits
  UNION ALL SELECT a.s, b.t, 6, 'II', CASE a.t WHEN 'u' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END
                   || CASE b.t WHEN 'u' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END
  FROM edits a JOIN edits b ON b.s = a.t
), ways AS (
  SELECT f.conv_id, f.i, v.s, v.t, v.cost, v.letter, v.line FROM faults f, LATERAL (
    SELECT s, s AS t, 4 AS cost, 'D' AS letter, '' AS line FROM (VALUES (''), ('s'), ('u'), ('a')) d(s)
    UNION ALL
    SELECT s, t, CASE WHEN f.fault = 't' THEN 3 ELSE 0 END, 'K', chr(10) || f.role || ':' || f.text
    FROM (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) k(s, t) WHERE t = left(f.role, 1) AND f.fault IN ('', 't')
    UNION ALL
    SELECT s, t, CASE WHEN f.fault = 't' THEN 6 ELSE 3 END, 'R', chr(10) || CASE t WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text
    FROM edits WHERE f.fault IN ('', 't')
  ) v
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS s, 0 AS cost, '' AS audit, '' AS turns FROM counts
  UNION ALL
  SELECT conv_id, i, s, b.cost, b.audit, b.turns FROM (
    SELECT w.conv_id, w.i + 1 AS i, y.t AS s,
           min({{'cost': w.cost + n.cost + y.cost, 'audit': w.audit || n.letters || y.letter, 'turns': w.turns || n.added || y.line}}) AS b
    FROM walk w JOIN inserts n ON n.s = w.s JOIN ways y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.i = w.i + 1 AND y.s = n.t
    GROUP BY w.conv_id, w.i, y.t)
), ended AS (
  SELECT w.conv_id, min({{'cost': w.cost + n.cost, 'audit': w.audit || n.letters, 'turns': w.turns || n.added}}) AS b
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts n ON n.s = w.s
  WHERE n.t IN ('', 'a') GROUP BY w.conv_id
)
SELECT ids.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.b.cost, 0) AS BIGINT) AS cost,
       coalesce(e.b.audit, '') AS audit, sha256(substr(coalesce(e.b.turns, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
