"""Conversation structure repair: the cheapest edits that leave an optional system turn and whole user-assistant pairs.

A conversation is repaired by choosing which turns are retained, kept as they are or with
another role; what lies between two retained turns is deleted, and the pair of their
roles says what has to be inserted between them. Prefix sums of deletions price the gaps, so
the best predecessor is a running minimum for each role, and equal costs are decided by the least audit.

Conversations are dealt out by ranges of (conv_id, turn), so a very long one is cut into pieces of bounded size. A piece
is solved for each role that may stand before it; the pieces' costs are then put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialise, settings

#: What comes last among the turns that stay: nothing, a system turn, a user's, an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
ROLE_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: (last role, next role): turns that have to be inserted between them. Other pairs can't follow each other.
BETWEEN = {(x, y): int((x == USER) == (y == USER)) for x in STATES for y in (USER, ASSISTANT)} | {(NOTHING, SYSTEM): 0}
#: Turns that have to be inserted at the end.
AT_END = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: First fault of a row.
FINE, BLANK, DUPLICATE, CUT = range(4)
LEGAL = {"su", "ua", "au"}
#: Rows of a piece at most.
PIECE = 4096
WHITE = " \t\n\x0b\x0c\r"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space there, in roles and in texts.

    0: the row goes (``gone``, so that its conversation stays known), 1: no text, 2: no ``.!?``, 3: twice, 4: role user.
    """
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    kind = turns.withColumn("_kind", F.crc32(name.cast("binary")) % 20)
    text = F.when(F.col("_kind") <= 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = kind.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("gone"), twice.alias("_copy"))
    return rows.drop("_copy")


def transfer(rows: list[tuple[str, int]], before: int) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) of the edits of ``rows`` for each role that may come last after them, if ``before`` comes last before them.

    A row is (initial of its role, fault). Inserted turns stand right before the retained turn that needs
    them, after the deletions of their gap; none follow the last row. For each last role the best
    retained row so far is held with its cost less the deletions up to it (``prefix``), so a gap of any length costs one
    comparison. Audits of as many rows that end in the same role and cost the same are never prefixes of each other, so the least stays the least
    whatever follows.
    """
    prefix = [DELETE * i for i in range(len(rows) + 1)]
    # state -> (cost less deletions so far, audit without the deletions behind it, rows that it covers)
    best = {before: (0, "", 0)}

    def offer(new: dict, state: int, cost: int, audit: str, end: int) -> None:
        old = new.get(state)
        if old is None or cost < old[0] or (cost == old[0] and audit < old[1] + "D" * (end - old[2])):
            new[state] = (cost, audit, end)

    for i, (initial, fault) in enumerate(rows):
        if fault in (BLANK, DUPLICATE):
            continue
        own = TRUNCATED if fault == CUT else 0
        found: dict = {}
        for last, (cost, audit, end) in best.items():
            gap = audit + "D" * (i - end)
            for role in (SYSTEM, USER, ASSISTANT):
                inserts = BETWEEN.get((last, role))
                if inserts is None:
                    continue
                total = cost + prefix[i] + inserts * INSERT + own - prefix[i + 1]
                if ROLE_STATE.get(initial) == role:
                    offer(found, role, total, gap + "I" * inserts + "K", i + 1)
                if role != SYSTEM:
                    offer(found, role, total + REROLE, gap + "I" * inserts + "R", i + 1)
        for state, (cost, audit, end) in found.items():
            offer(best, state, cost, audit, end)
    return {state: (cost + prefix[-1], audit + "D" * (len(rows) - end)) for state, (cost, audit, end) in best.items()}


def ended(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min((cost + AT_END[s] * INSERT, audit + "I" * AT_END[s]) for s, (cost, audit) in ends.items())


def repaired(audit: str, rows: list[tuple[str, str]], last: int) -> tuple[list[str], int]:
    """``role:text`` lines that an audit leaves of (role, text) rows, and the role that comes last."""
    out, i = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[i]
        i += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            last = ROLE_STATE[role[:1]]
        else:
            last = ASSISTANT if last == USER else USER
            role = NAMES[last]
        out.append(f"{role}:{text}")
    return out, last


class Piece:
    """Rows of a conversation in their order, with the counts that need no other piece."""

    def __init__(self, conv_id: int | None, first: bool):
        self.conv_id, self.first = conv_id, first
        self.rows, self.roles, self.texts, self.faults = [], [], [], [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if self.rows and self.rows[-1][0] + role[:1] not in LEGAL:
            self.illegal += 1
        self.rows.append((role[:1], fault))
        self.roles.append(role)
        self.texts.append(text)
        self.faults[fault] += 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn


NARROW = "conv_id long, part int, piece int, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long, costs array<long>, ranks array<int>"
PIECES = f"{NARROW}, open boolean, audits array<string>, roles array<string>, texts array<string>, cost long, audit string, repaired_sha256 string"


def _piece_row(p: Piece, part: int, number: int, is_open: bool) -> tuple:
    first, last = (p.rows[0][0], p.rows[-1][0]) if p.rows else (None, None)
    narrow = [p.conv_id, part, number, *p.faults[1:], p.illegal, first, last, p.turns, p.low, p.high]
    if not is_open:
        cost, audit = ended(transfer(p.rows, NOTHING))
        lines, last_role = repaired(audit, list(zip(p.roles, p.texts, strict=True)), NOTHING)
        return (*narrow, None, None, False, None, None, None, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    found = {(x, y): v for x in STATES for y, v in transfer(p.rows, x).items()}
    order = {a: k for k, a in enumerate(sorted({a for _, a in found.values()}))}
    cells = [found.get((x, y)) for x in STATES for y in STATES]
    costs, ranks, audits = ([f(c) if c else None for c in cells] for f in (lambda c: c[0], lambda c: order[c[1]], lambda c: c[1]))
    return (*narrow, costs, ranks, True, audits, p.roles, p.texts, None, None, None)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def cut(rows: Iterable[tuple], most: int) -> Iterator[tuple[Piece, bool]]:
    """Pieces of a sorted run of (conv_id, turn, role, key, kind, fault, text), and whether other rows of their conversation may lie elsewhere.

    Kind 0 announces that the next row with these turn, role and key is the first of its role and text;
    kind 1 is a row, kind 2 one that is gone. A run may begin and end within a conversation; one of more than ``most`` rows is cut.
    """
    piece, fresh, whole = None, None, False
    for conv_id, turn, role, key, kind, fault, text in rows:
        if piece is None or conv_id != piece.conv_id:
            if piece is not None:
                yield piece, not whole
            whole = piece is not None  # the run's first conversation may have begun before it
            piece, fresh = Piece(conv_id, True), None
        if kind == 0:
            fresh = (turn, role, key)
        elif kind == 1:
            new = fresh == (turn, role, key)
            fresh = None if new else fresh
            if len(piece.rows) == most:
                yield piece, True
                piece, whole = Piece(conv_id, False), False
            piece.add(turn, role, text, fault if new or fault == BLANK else DUPLICATE)
    if piece is not None:
        yield piece, True


def pieces(turns: DataFrame, most: int = PIECE) -> DataFrame:
    """PIECES of damaged ``turns`` (conv_id, turn, role, text, gone). A conversation within one task is solved there; of others the costs for each role before and behind are given.

    Turns are in the order of turn (nulls first), role and SHA-256 of the text. The first row of each role
    and text of a conversation is found by an aggregate over all rows, and sorted right before its row.
    """
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    trimmed = F.rtrim("text", F.lit(WHITE))
    fault = F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    rows = turns.select("conv_id", "turn", "role", key.alias("key"), F.when(F.col("gone"), 2).otherwise(1).alias("kind"), fault.alias("fault"), "text")
    turn = F.when(F.count(F.when(F.col("turn").isNull(), 1)) > 0, None).otherwise(F.min("turn"))
    firsts = rows.where("kind = 1").groupBy("conv_id", "role", "key").agg(turn.alias("turn"))
    firsts = firsts.select("conv_id", "turn", "role", "key", F.lit(0).alias("kind"), F.lit(0).alias("fault"), F.lit("").alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "key")]
    schema = _arrow(PIECES)

    def solve(batches):
        part, out = TaskContext.get().partitionId(), []
        each = (r for b in chunks(batches, "text") for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for number, (piece, is_open) in enumerate(cut(each, most)):
            out.append(_piece_row(piece, part, number, is_open))
            if len(out) == 500 or is_open:
                yield _table(out, schema)
                out = []
        if out:
            yield _table(out, schema)

    return rows.unionByName(firsts).repartitionByRange(*order).sortWithinPartitions(*order, "kind").mapInArrow(solve, PIECES)


def put_together(table: pa.Table) -> pa.Table:
    """Of one conversation's pieces (NARROW): the role before each, the place of its edits among its ``audits``, and the conversation's counts beside the first.

    From the last piece back, the least (cost, rank) for each role before; ranks order a piece's audits. At the end, inserted turns count.
    """
    rows = table.sort_by([("part", "ascending"), ("piece", "ascending")]).to_pylist()
    behind = {s: AT_END[s] * INSERT for s in STATES}
    steps = []
    for r in reversed(rows):
        options = {x: [(r["costs"][4 * x + y] + behind[y], r["ranks"][4 * x + y], y) for y in STATES if r["costs"][4 * x + y] is not None] for x in STATES}
        # ranks are of audits as long as each other; behind the last piece, fewer inserted turns cost less
        chosen = {x: min(o) for x, o in options.items()}
        steps.append({x: c[2] for x, c in chosen.items()})
        behind = {x: c[0] for x, c in chosen.items()}
    total, state = behind[NOTHING], NOTHING
    illegal, turns, last, high, low = 0, 0, None, None, None
    out = []
    for r, step in zip(rows, reversed(steps), strict=True):
        out.append({"part": r["part"], "piece": r["piece"], "before": state, "cell": 4 * state + step[state]})
        state = step[state]
        illegal += r["illegal"] + (last is not None and r["first"] is not None and last + r["first"] not in LEGAL)
        last = r["last"] if r["first"] is not None else last
        turns += r["turns"] - (r["low"] is not None and r["low"] == high)
        low, high = (r["low"] if low is None else low), (high if r["high"] is None else r["high"])
    sums = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")}
    counts = sums | {"illegal": illegal, "gaps": 0 if low is None else high - low + 1 - turns, "cost": total}
    names = [x.split() for x in CHOSEN.split(", ")]
    for k, o in enumerate(out):
        o |= counts if k == 0 else dict.fromkeys(counts)
        o["end"] = AT_END[state] if k == len(out) - 1 else 0
    schema = _arrow(CHOSEN)
    return pa.table({n: pa.array([o[n] for o in out], schema.field(n).type) for n, _ in names}, schema=schema)


CHOSEN = "part int, piece int, before int, cell int, end int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def hashed(rows: Iterable[dict]) -> Iterator[tuple]:
    """RESULT of conversations whose solved pieces come one after the other. Lines are hashed as they come; a conversation's audit is all that is held."""
    conv, done, digest, audit, counts, begun = None, True, None, None, None, False
    for r in rows:
        if r["counts"] is not None:
            if not done:
                yield (conv, *counts, "".join(audit), digest.hexdigest())
            conv, done, digest, audit, begun = r["conv_id"], False, hashlib.sha256(), [], False
            counts = r["counts"]
        edits = r["audit"] + "I" * r["end"]
        lines, _ = repaired(edits, list(zip(r["roles"], r["texts"], strict=True)), r["before"])
        if lines:
            digest.update(("\n" * begun + "\n".join(lines)).encode())
            begun = True
        audit.append(edits)
    if not done:
        yield (conv, *counts, "".join(audit), digest.hexdigest())


def repair(turns: DataFrame, most: int = PIECE) -> DataFrame:
    """RESULT for each conversation of ``turns`` (conv_id, turn, role, text, and gone: a row that only says that its conversation exists).

    Faults, counts and edits are those of the contract; rows of the same turn are in the order of role and SHA-256 of the text.
    Null conversation ids are one conversation. A conversation without rows has zeros, an empty audit and the hash of nothing.

    What no task can hold alone is one conversation's pieces: they are solved where they are; put together are only their
    16 costs and ranks each. The hash of a repaired conversation is sequential by its definition, so its texts pass through one task, piece by piece.
    """
    spark = turns.sparkSession
    found = materialise(pieces(turns, most), "pieces")
    closed = found.where("NOT open")
    gaps = F.when(F.col("low").isNull(), F.lit(0).cast("long")).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    names = [x.split()[0] for x in RESULT.split(", ")]
    closed = closed.withColumn("gaps", gaps).select(*names)
    several = found.where("open")
    narrow = several.select(*(x.split()[0] for x in NARROW.split(", ")))
    chosen = materialise(narrow.groupBy("conv_id").applyInArrow(put_together, CHOSEN), "chosen")
    counts = F.when(F.col("gaps").isNotNull(), F.array("gaps", *(F.col(f"c.{c}") for c in ("blank", "duplicate", "truncated", "illegal", "cost")))).alias("counts")
    solved = several.alias("p").join(chosen.alias("c"), (F.col("p.part") == F.col("c.part")) & (F.col("p.piece") == F.col("c.piece")))
    solved = solved.select("p.conv_id", "p.part", "p.piece", "roles", "texts", F.get("audits", F.col("cell")).alias("audit"), "before", "end", counts)
    schema = _arrow(RESULT)

    def finish(batches):
        each = (r for b in batches for r in b.to_pylist())
        for row in hashed(each):
            yield _table([row], schema)

    solved = solved.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}):  # a row has up to ``most`` texts
        rest = materialise(solved.mapInArrow(finish, RESULT), "repaired")
    return closed.unionByName(rest)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages ``conversations`` as ``damaged`` does and repairs every conversation; a row for each conv_id, with the columns RESULT."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_POLYNOMIAL = 3988292384
#: The same by SQL: crc32 from its table, and a step for each row that keeps the least (cost, audit) of each conversation and last role.
OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {_POLYNOMIAL}) ELSE a >> 1 END) AS c FROM range(256) r(i))),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS d FROM named, crc),
hurt AS (
    SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, LATERAL (SELECT unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END))) WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
bare AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS b, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
r AS (SELECT *, role[1] AS ini, CASE WHEN b = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT suffix(b, '.') AND NOT suffix(b, '!') AND NOT suffix(b, '?') THEN 'truncated' ELSE '' END AS fault FROM bare),
pairs AS (SELECT conv_id, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS p FROM r),
bad AS (SELECT conv_id, count(*) FILTER (p NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM r GROUP BY conv_id),
moves(st, kind, ins, line, nst) AS (VALUES (0, 's', '', '', 1), (0, 'u', '', '', 2), (1, 'u', '', '', 2), (3, 'u', '', '', 2), (2, 'u', 'I', 'assistant:', 2), (2, 'a', '', '', 3), (0, 'a', 'I', 'user:', 3), (1, 'a', 'I', 'user:', 3), (3, 'a', 'I', 'user:', 3)),
edits AS (
    SELECT st, 'D' AS edit, NULL AS kind, '' AS ins, '' AS line, nst FROM (VALUES (0, 0), (1, 1), (2, 2), (3, 3)) v(st, nst)
    UNION ALL SELECT st, 'K', kind, ins, line, nst FROM moves UNION ALL SELECT st, 'R', kind, ins, line, nst FROM moves WHERE kind <> 's'),
dp AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS st, {{'cost': 0::BIGINT, 'audit': '', 'out': []::VARCHAR[]}} AS best FROM conversations
    UNION ALL
    SELECT dp.conv_id, dp.i + 1, e.nst, min({{
        'cost': best.cost + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + 3 * length(e.ins) + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END,
        'audit': best.audit || e.ins || e.edit,
        'out': best.out || CASE WHEN e.ins = '' THEN []::VARCHAR[] ELSE [e.line] END || CASE e.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE e.kind WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text] END}})
    FROM dp JOIN r ON dp.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = dp.i + 1 JOIN edits e USING (st)
    WHERE e.edit = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.kind = r.ini))
    GROUP BY dp.conv_id, dp.i, e.nst),
ends(st, ins, lines) AS (VALUES (0, '', []::VARCHAR[]), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', []::VARCHAR[])),
done AS (
    SELECT dp.conv_id, min({{'cost': best.cost + 3 * length(ins), 'audit': best.audit || ins, 'out': best.out || lines}}) AS b
    FROM dp JOIN ends USING (st) LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = coalesce(c.n, 0) GROUP BY dp.conv_id)
SELECT done.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit, sha256(array_to_string(b.out, chr(10))) AS repaired_sha256
FROM done LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM done.conv_id LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM done.conv_id
"""
