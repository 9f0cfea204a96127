"""Operator 13, repair of a conversation's structure over a suffix-shared automaton.

Every message becomes one letter of its conversation's signature: the role that
may be kept, whether the text breaks off, or that the message must go. Distinct
signatures are sorted by their reversed text, so those with a common ending lie
side by side and share the automaton nodes of that ending: cost-to-go and best
next edit are worked out once per node and grammar state, whichever
conversations pass there. Texts are moved once, for the repaired output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.registry import register
from cohortspark.llm.tables import numbered, settled, shuffle_partitions, table
from cohortspark.operators.skew import SkewPolicy, attach

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3   # costs; the last one is added to an undeleted message
CHUNK = 4_096                    # messages of a conversation that one row of the first grouping holds
ENDING = 64                      # letters that deal the signatures out by their ending
POLICY = SkewPolicy(task_rows=20_000, broadcast_rows=0)
BLANKS = " \t\n\x0b\x0c\r"

# Grammar states: nothing yet, after a leading system message, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
ROLES = {USER: "user", ASSISTANT: "assistant"}
SPOKEN = [USER, USER, ASSISTANT, USER]                              # the one role that may be put in at each state
KEPT = {"s": [SYSTEM, None, None, None], "u": [USER, USER, None, USER], "a": [None, None, ASSISTANT, None],
        "o": [None] * 4}
# Letters: s u a o as they are, S U A O broken off, - must go.


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: by the checksum of conversation and turn a row goes, is emptied, loses its
    closing marks, is repeated or becomes the user's; NULL role and text are one space."""
    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    mark = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    role, text = shown("role"), shown("text")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), mark.alias("mark")).where(
        "mark <> 0").select(
        "conv_id", "turn", F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("mark") == 3, 2).otherwise(1).cast("int"))).alias("_copy")
    ).drop("_copy")


def order_in(digest: Column) -> list[Column]:
    """Messages of one turn lie by role and digest of the text, so repeated ones are neighbours."""
    return [F.col("conv_id"), F.col("turn"), F.col("role"), digest]


def messages(rows: DataFrame) -> DataFrame:
    """One narrow row per message: place in the table, letter, initial and first fault."""
    bare = F.rtrim("text", F.lit(BLANKS))
    narrow = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (F.length(bare) == 0).alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("at"))
    placed = numbered(narrow, [*order_in(F.col("digest")), F.col("at")])
    new = placed.groupBy("conv_id", "role", "digest").agg(F.min("rank").alias("rank")).select(
        "rank", F.lit(True).alias("new"))
    first = F.substring("role", 1, 1)
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("cut"), "truncated")
    known = placed.join(new, "rank", "left").select("conv_id", "turn", "rank", letter.alias("initial"), fault.alias("fault"))
    return known.withColumn("letter", F.when(F.col("fault").isin("blank", "duplicate"), "-").when(
        F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation with messages: counts and signature.

    Chunks of ``CHUNK`` messages are strung together first, so a task meets
    letters of a long conversation only as strings, as long in all as its audit.
    """
    def strung(c):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]), "")

    told = settled(messages(rows))
    counts = told.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1).alias("span"), F.count_distinct("turn").alias("turns"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    chunks = told.groupBy("conv_id", F.floor(F.col("rank") / CHUNK).alias("rank")).agg(
        strung("letter").alias("letter"), strung("initial").alias("initial"))
    whole = chunks.groupBy("conv_id").agg(strung("letter").alias("signature"), strung("initial").alias("initials"))
    fair = F.regexp_count("initials", F.lit("(?=su|ua|au)"))
    return whole.withColumnRenamed("conv_id", "c").join(counts, F.col("c").eqNullSafe(F.col("conv_id"))).select(
        "conv_id", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", (F.length("initials") - 1 - fair).cast("long").alias("illegal"), "signature")


@cache
def step(letter: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], str]:
    """The node before ``letter``: added cost, cost-to-go of each state above it, best first edit of each state.

    ``after`` are the costs-to-go of the node behind, less their least one.
    Few such tuples exist, so nodes with equal futures are worked out together.
    """
    extra = TRUNCATED if letter.isupper() else 0
    own = []
    for state in range(4):
        ways = [(DELETE + after[state], "D")]
        if letter != "-":
            ways.append((REROLE + extra + after[SPOKEN[state]], "R"))
            kept = KEPT[letter.lower()][state]
            if kept is not None:
                ways.append((KEEP + extra + after[kept], "K"))
        own.append(min(ways))
    return settle(own)


def settle(own: list[tuple[int, str]]) -> tuple[int, tuple[int, ...], str]:
    """Let a message be put in first where that is cheaper, or as cheap and earlier in ASCII."""
    costs = [c for c, _ in own]
    for _ in range(3):
        costs = [min(c, INSERT + costs[SPOKEN[state]]) for state, c in enumerate(costs)]
    best = []
    for state, (c, edit) in enumerate(own):
        ways = [edit] if c == costs[state] else []
        best.append(min(ways + (["I"] if INSERT + costs[SPOKEN[state]] == costs[state] else [])))
    least = min(costs)
    return least, tuple(c - least for c in costs), "".join(best)


def end() -> tuple[int, tuple[int, ...], str]:
    """The node behind the last message; ``.`` ends a conversation."""
    return settle([(0, "."), (FAR, "."), (FAR, "."), (0, ".")])


class Automaton:
    """Nodes of the current signature's endings, the shared ones kept from the signature before."""

    def __init__(self):
        least, costs, best = end()
        self.letters = ""                        # of the current signature, last letter first
        self.nodes = [(least, costs, best)]      # one per ending: cost, costs above it, first edits
        self.made = 0

    def audit(self, reversed_signature: str) -> tuple[int, str]:
        """Cost and the ASCII-least cheapest edits of one signature."""
        shared = 0
        top = min(len(self.letters), len(reversed_signature))
        while shared < top and self.letters[shared] == reversed_signature[shared]:
            shared += 1
        del self.nodes[shared + 1:]
        for letter in reversed_signature[shared:]:
            cost, after, _ = self.nodes[-1]
            more, costs, best = step(letter, after)
            self.nodes.append((cost + more, costs, best))
            self.made += 1
        self.letters = reversed_signature
        cost, costs, _ = self.nodes[-1]
        edits, state, at = [], START, len(self.nodes) - 1
        while (edit := self.nodes[at][2][state]) != ".":
            edits.append(edit)
            if edit == "I":
                state = SPOKEN[state]
                continue
            at -= 1
            state = follow(edit, reversed_signature[at], state)
        return cost + costs[START], "".join(edits)


def follow(edit: str, letter: str, state: int) -> int:
    if edit == "D":
        return state
    return SPOKEN[state] if edit == "R" else KEPT[letter.lower()][state]


def audits(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature."""
    def walking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            found = [automaton.audit(s) for s in batch.column("backwards").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "signature": batch.column("signature"), "cost": pa.array([c for c, _ in found], pa.int64()),
                "audit": pa.array([a for _, a in found], pa.string())})

    backwards = F.reverse("signature")
    dealt = signed.select("signature").distinct().withColumn("backwards", backwards).repartitionByRange(
        shuffle_partitions(signed.sparkSession), F.substring("backwards", 1, ENDING), F.xxhash64("signature"))
    return dealt.sortWithinPartitions("backwards").mapInArrow(walking, "signature string, cost long, audit string")


def plan(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text)`` that has messages.

    conv_id, gaps, blank, duplicate, truncated, illegal, signature, cost and
    audit: the cheapest edits (Keep, Rerole, Delete, Insert) that give role
    initials ``(s?(ua)+)?``, ties the ASCII-least. Messages lie by turn (NULL
    first), then role, then digest of the text. A message is blank, else a
    duplicate of an earlier role and text of its conversation, else truncated;
    the first two must go. Another role than s, u, a can be changed or deleted.

    Roles and texts must not be NULL (``damaged`` fills them). NULL is a conversation id
    like any other; NULL turns count for no gap; repeated rows are messages;
    an empty table gives no row; other columns are not read. No task holds the
    messages of a conversation: they are numbered by ranges of the whole table,
    first occurrences are a minimum, joined by number. Long texts are only digested.
    """
    signed = settled(signatures(rows))
    return attach(signed, audits(signed), ["signature"], policy=POLICY)


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The messages of the repaired conversations: conv_id, place (from 0), role, text.

    A conversation's rows come in order and in one partition, behind its plan;
    the task streams them and holds one batch and one audit at a time, so
    neither long texts nor a long conversation are held. Conversations of
    which nothing is left give no row.
    """
    def editing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, conv = "", 0, START, 0, None
        out: list[tuple] = []

        def put(role, text):
            nonlocal place
            out.append((conv, place, role, text))
            place += 1

        def inserts():
            nonlocal at, state
            while audit[at:at + 1] == "I":
                state = SPOKEN[state]
                at += 1
                put(ROLES[state], "")

        for batch in batches:
            for c, lead, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text"))):
                if lead is not None:
                    inserts()
                    audit, at, state, place, conv = lead, 0, START, 0, c
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "R":
                    state = SPOKEN[state]
                    put(ROLES[state], text)
                elif edit == "K":
                    state = KEPT[role[:1]][state]
                    put(role, text)
            yield told(out)
            out.clear()
        inserts()
        yield told(out)

    def told(out):
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], kinds)

    conv = rows.schema["conv_id"].dataType
    names = ["conv_id", "place", "role", "text"]
    empty = plans.select("conv_id").limit(0).toArrow().schema.field("conv_id").type
    kinds = pa.schema([("conv_id", empty), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    lines = rows.select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"),
                        F.lit(None).cast("string").alias("audit"))
    leads = plans.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
                         F.lit("").alias("text"), F.lit(None).cast("binary").alias("digest"), "audit")
    dealt = lines.unionByName(leads).repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(
        F.col("conv_id"), F.col("audit").isNull(), *order_in(F.col("digest"))[1:])
    return dealt.select("conv_id", "audit", "role", "text").mapInArrow(
        editing, f"conv_id {conv.simpleString()}, place long, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` lines; reads the stream of ``repaired`` where it is made."""
    def hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, conv = None, None
        for batch in batches:
            done, rows = [], zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "role", "text")))
            for _, mine in groupby(rows, key=lambda r: r[0]):
                for c, place, role, text in mine:
                    if place == 0:
                        if running is not None:
                            done.append((conv, running.hexdigest()))
                        running, conv = hashlib.sha256(), c
                    running.update((("\n" if place else "") + role + ":" + text).encode())
            yield told(done, batch.schema)
            last = batch.schema
        if running is not None:
            yield told([(conv, running.hexdigest())], last)

    def told(done, schema):
        return pa.RecordBatch.from_pydict({
            "conv_id": pa.array([c for c, _ in done], schema.field("conv_id").type),
            "sha256": pa.array([d for _, d in done], pa.string())})

    return turns.mapInArrow(hashing, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, sha256 string")


NOTHING = hashlib.sha256(b"").hexdigest()


def report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``original``: what is wrong in ``rows``, the cheapest repair and its digest."""
    plans = settled(plan(rows).drop("signature"))
    hashed = digests(repaired(rows, plans)).withColumnRenamed("conv_id", "h")
    every = original.select(F.col("conv_id").alias("o")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (every.join(plans, F.col("o").eqNullSafe(F.col("conv_id")), "left")
            .join(hashed, F.col("o").eqNullSafe(F.col("h")), "left").select(
                F.col("o").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("sha256", F.lit(NOTHING)).alias("repaired_sha256")))


def _sql() -> str:
    """Cost, audit and text of every ending and state, one message a step from the last one back."""
    def way(cost, edit, to, line=None):
        text = f"{line} || {to}.t" if line else f"{to}.t"
        return f"{{'c': {cost} + {to}.c, 'a': '{edit}' || {to}.a, 't': {text}}}"

    def least(*ways):
        return f"list_sort([{', '.join(ways)}])[1]"

    def put(to, role):
        return way(INSERT, "I", to, f"chr(10) || '{role}:'")

    next_of, said = [2, 2, 3, 2], ["user", "user", "assistant", "user"]
    own = []
    for q in range(4):
        to = f"v{next_of[q]}"
        kept = " ".join(
            f"WHEN initial = '{i}' THEN {way('extra', 'K', f'v{t[q]}', 'chr(10) || role || chr(58) || text')}"
            for i, t in (("s", [1, None, None, None]), ("u", [2, 2, None, 2]), ("a", [None, None, 3, None])) if t[q])
        line = f"chr(10) || '{said[q]}:' || text"
        gone = way(DELETE, "D", f"v{q}")
        changed = way(f"{REROLE} + extra", "R", to, line)
        kept = f"CASE {kept} ELSE {changed} END" if kept else changed
        own.append(f"CASE WHEN dead THEN {gone} ELSE {least(gone, changed, kept)} END AS w{q}")
    far = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    one, two = "{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'}", \
        "{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE bits(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
  COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' ') AS key FROM conversations),
marked AS (SELECT * EXCLUDE (t), xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(range(1, length(key) + 1), lambda p: ord(substr(key, p, 1))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS mark FROM keyed, crc),
damage AS (SELECT conv_id, turn, CASE WHEN mark = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN mark = 1 THEN '' WHEN mark = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM marked, range(2) r(copy) WHERE mark <> 0 AND (copy = 0 OR mark = 3)),
numbered AS (SELECT *, rtrim(text, {blanks}) AS bare, ROW_NUMBER() OVER (PARTITION BY conv_id
  ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM damage),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen FROM numbered),
told AS (SELECT *, substr(role, 1, 1) AS initial, bare = '' AS blank, bare <> '' AND seen > 1 AS dup,
  bare <> '' AND seen = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM ranked),
lines AS (SELECT *, blank OR dup AS dead, CASE WHEN cut THEN {TRUNCATED} ELSE 0 END AS extra,
  LAG(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM told),
counts AS (SELECT conv_id, MAX(k) AS n, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps,
  COUNT(*) FILTER (blank) AS blank, COUNT(*) FILTER (dup) AS duplicate, COUNT(*) FILTER (cut) AS truncated,
  COUNT(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM lines GROUP BY conv_id),
back AS (SELECT conv_id, n + 1 AS k, {far} AS v0, {two} AS v1, {one} AS v2, {far} AS v3 FROM counts
  UNION ALL SELECT conv_id, k, {least('w0', put('w2', 'user'), way(INSERT, 'I', put('w3', 'assistant').join(('(', ')')), "chr(10) || 'user:'"))},
    {least('w1', put('w2', 'user'), way(INSERT, 'I', put('w3', 'assistant').join(('(', ')')), "chr(10) || 'user:'"))},
    {least('w2', put('w3', 'assistant'))}, {least('w3', put('w2', 'user'))}
  FROM (SELECT b.conv_id, l.k, {', '.join(own)} FROM back b JOIN lines l
    ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.k = b.k - 1))
SELECT o.conv_id, COALESCE(gaps, 0)::BIGINT AS gaps, COALESCE(blank, 0)::BIGINT AS blank,
  COALESCE(duplicate, 0)::BIGINT AS duplicate, COALESCE(truncated, 0)::BIGINT AS truncated,
  COALESCE(illegal, 0)::BIGINT AS illegal, COALESCE(v0.c, 0)::BIGINT AS cost, COALESCE(v0.a, '') AS audit,
  sha256(COALESCE(substr(v0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM back WHERE k = 1) b ON o.conv_id IS NOT DISTINCT FROM b.conv_id"""


@register("op13_conversation_repair", _sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return report(rows, damaged(rows))
