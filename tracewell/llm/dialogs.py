"""Repair of conversation structure by iterative-deepening A*.

A conversation is read as role initials with a fault each; the repair is the
cheapest sequence of edits (Delete, Insert, Keep, Rerole) that leaves initials of
the form (s?(ua)+)?, ties going to the least in ASCII. A depth-first search tries
edits in that order under a bound on the cost; a state (row, place in the form)
that failed keeps the least cost that would have been needed, which prunes it
when it is met again and raises the next bound. The first accepting path is the
answer.

Conversations are cut into chunks of ``CHUNK`` rows of one byte each. One that
fits a chunk is searched as it stands. For longer ones the least costs from each
place to each place are added up chunk by chunk from the end, so that every
chunk is searched by itself, for each place it may begin at, with the cost of what follows as
the price of its exits; the choices are then linked from the start. So the length
of a conversation bounds no task. Only the hash of a repaired conversation needs
its texts in one sequence: they pass through one task in order, a batch at a time.

Defined cases: a null conversation, role or text counts as one space in hashes of
places and in what is repaired; null conversations are one conversation; null
turns come first; rows of one turn go by role, then by text (the first
``HEAD`` characters, then SHA-256); repeated rows are rows of their own; a
conversation that loses all its rows stays with zeros and an empty audit; an
empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.tables import scratch, stored

CHUNK, HEAD = 128, 64
# Costs of edits, what keeping a truncated row adds, and the places in the form: before it, after s, after u, after a.
DELETE, INSERT, KEEP, REROLE, CUT_OFF = 2, 5, 0, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 40
#: White space, and ends of sentences.
WHITE, END = " \t\n\x0b\x0c\r", r"[.!?]"
LEGAL_PAIRS = ("su", "ua", "au")
#: A row's byte: initial (s, u, a, other) + 4 * fault (none, truncated, blank, duplicate).
INITIALS, SOUND, TRUNCATED, BLANK, DUPLICATE = "sua", 0, 1, 2, 3


def _follows(place: int) -> int:
    return ASSISTANT if place == USER else USER


def _kept(place: int, initial: int) -> int | None:
    """The place after a row whose initial stays, or None where the form forbids it."""
    if initial == 0:
        return SYSTEM if place == START else None
    if initial in (1, 2):
        return _follows(place) if _follows(place) == initial + 1 else None
    return None


def _steps() -> list[list[list[tuple[str, int, int, int]]]]:
    """For each row byte and place: (edit, cost, next place, rows taken) in ASCII order."""
    out = []
    for byte in range(16):
        initial, fault = byte % 4, byte // 4
        more = CUT_OFF if fault == TRUNCATED else 0
        each = []
        for place in range(4):
            edits = [("D", DELETE, place, 1), ("I", INSERT, _follows(place), 0)]
            if fault not in (BLANK, DUPLICATE):
                if (kept := _kept(place, initial)) is not None:
                    edits.append(("K", KEEP + more, kept, 1))
                edits.append(("R", REROLE + more, _follows(place), 1))
            each.append(edits)
        out.append(each)
    return out


STEPS = _steps()
#: The least that a row costs whatever stands around it.
LEAST = [min(c for place in each for _, c, _, taken in place if taken) for each in STEPS]


class Search:
    """Cheapest edits of ``rows`` from a place; ``exits`` has the cost of what follows for each place at their end, and ``last`` allows inserts there."""

    def __init__(self, rows: bytes, exits: list[int], last: bool):
        self.rows, self.exits, self.last = rows, exits, last
        ahead = [min(exits)] if not last else [0]
        for b in reversed(rows):
            ahead.append(ahead[-1] + LEAST[b])
        ahead.reverse()
        #: The least cost that remains, as far as it is known, of each state: at first an estimate from the rows, then what failures have shown.
        self.remains = [[h] * 4 for h in ahead]

    def run(self, place: int, bound: int | None = None) -> tuple[int, str, int]:
        """(cost with what follows, edits, place at the end); the cost is at least NEVER if no edits lead to an end. ``bound``: where to begin, no more than the cost."""
        bound = max(self.remains[0][place], bound or 0)
        while bound < NEVER:
            path: list[str] = []
            found = self._dive(0, place, bound, path)
            if found is not None:
                return bound, "".join(path), found
            bound = max(bound + 1, self.remains[0][place])
        return NEVER, "", place

    def _dive(self, row: int, place: int, left: int, path: list[str]) -> int | None:
        """The place at the end of the first accepting path of at most ``left``, which ``path`` then holds; else None, and the state's remaining cost is raised."""
        remains = self.remains[row]
        if remains[place] > left:
            return None
        least = NEVER
        if row == len(self.rows):
            if self.exits[place] <= left:
                return place
            least = self.exits[place]
            edits = [("I", INSERT, _follows(place), 0)] if self.last else []
        else:
            edits = STEPS[self.rows[row]][place]
        for name, cost, then, taken in edits:
            ahead = self.remains[row + taken]
            if cost + ahead[then] <= left:
                path.append(name)
                found = self._dive(row + taken, then, left - cost, path)
                if found is not None:
                    return found
                path.pop()
            least = min(least, cost + ahead[then])
        if least > remains[place]:
            remains[place] = least
        return None


#: Costs at the end of a conversation: the form is whole before it begins and after an assistant.
WHOLE = [0, NEVER, NEVER, 0]


def _one_crossing(byte: int) -> np.ndarray:
    step = np.full((4, 4), NEVER)
    for place in range(4):
        at, paid = place, 0
        for _ in range(3):  # inserts alternate: two lead to every place that any number does
            for _name, cost, then, taken in STEPS[byte][at]:
                if taken:
                    step[place, then] = min(step[place, then], paid + cost)
            at, paid = _follows(at), paid + INSERT
    return step


CROSSINGS = [_one_crossing(b) for b in range(16)]


def crossing(rows: bytes) -> np.ndarray:
    """Least costs (4 x 4) of leading a chunk's rows from each place to each place, inserts standing before the rows that they lead to."""
    out = np.full((4, 4), NEVER)
    np.fill_diagonal(out, 0)
    for b in rows:
        out = np.minimum((out[:, :, None] + CROSSINGS[b][None, :, :]).min(1), NEVER)
    return out


def _ending(exits: list[int]) -> list[int]:
    """Costs of each place at the end, if inserts may still come there."""
    out = list(exits)
    for place in range(4):
        at, paid = place, 0
        for _ in range(3):
            out[place] = min(out[place], paid + exits[at])
            at, paid = _follows(at), paid + INSERT
    return out


def _whole(codes: pd.Series) -> pd.DataFrame:
    got = [Search(bytes(c), WHOLE, True).run(START) for c in codes]
    return pd.DataFrame({"cost": [g[0] for g in got], "audit": [g[1] for g in got]})


def _price(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs of what follows each chunk of one conversation, from its last chunk back."""
    pdf = pdf.sort_values("chunk")
    after, out = _ending(WHOLE), []
    for m in reversed(list(pdf["costs"])):
        out.append(after)
        after = np.minimum(np.asarray(m).reshape(4, 4) + np.asarray(after)[None, :], NEVER).min(1).tolist()
    return pd.DataFrame({"conv": pdf["conv"], "chunk": pdf["chunk"], "exits": out[::-1]})


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    """The path of each chunk of one conversation, from the place at which the one before it ended."""
    pdf, place = pdf.sort_values("chunk"), START
    chosen = []
    for paths in pdf["paths"]:
        p = paths[place]
        chosen.append((p["cost"], p["audit"]))
        place = p["end"]
    first = chosen[0][0] if chosen else 0
    return pd.DataFrame({"conv": pdf["conv"], "chunk": pdf["chunk"], "cost": [first] * len(chosen), "audit": [a for _, a in chosen]})


def spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role and text after damage by the CRC-32 of a row's place; copy is 1 for the repeat of a row and null for a row that was dropped. was_role and was_text are those before."""
    by = F.crc32(F.concat(spaced(F.col(conv)), F.lit(":"), spaced(F.col(turn))).cast("binary")) % 20
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(F.col(role)).alias("was_role"), spaced(F.col(text)).alias("was_text"), by.cast("int").alias("by"))
    text_ = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.regexp_replace("was_text", END, "")).otherwise(F.col("was_text"))
    role_ = F.when(F.col("by") == 4, "user").otherwise(F.col("was_role"))
    copies = F.when(F.col("by") == 0, F.array(F.lit(None).cast("int"))).when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return named.select("conv", "turn", role_.alias("role"), text_.alias("text"), "was_role", "was_text", F.explode(copies).alias("copy"))


#: Order of a conversation's rows; the digest stands for the rest of the text.
ORDER = ["turn", "was_role", "head", "digest", "copy"]


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"head": F.substring("was_text", 1, HEAD), "digest": F.unhex(F.sha2("was_text", 256))})


def _coded(rows: DataFrame) -> DataFrame:
    """conv, pos (rising along a conversation) and code of each row; no text travels."""
    ink = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    said = F.unhex(F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text"), 256))
    fault = F.when(ink == "", BLANK).when(~ink.rlike(END), TRUNCATED).otherwise(SOUND)
    compact = rows.filter("copy is not null").select("conv", *ORDER, initial.alias("initial"), said.alias("said"), fault.alias("fault"))
    # Equal rows may be dealt to several tasks: which of them comes first changes nothing.
    ranged = compact.withColumn("from", F.spark_partition_id()).repartitionByRange("conv", *ORDER, "from")
    placed = stored(ranged.sortWithinPartitions("conv", *ORDER).select("conv", "initial", "said", "fault", F.monotonically_increasing_id().alias("pos")), "dialog-rows")
    # Only what was said more than once meets its rows again.
    more = placed.groupBy("conv", "said").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n").withColumnRenamed("conv", "of")
    met = placed.join(more.withColumnRenamed("said", "again"), F.col("conv").eqNullSafe(F.col("of")) & (F.col("said") == F.col("again")), "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return met.select("conv", "pos", (F.col("initial") + 4 * fault).cast("int").alias("code"))


def _chunked(codes: DataFrame) -> DataFrame:
    """conv, chunk (its first place), codes and how many chunks the conversation has. A chunk never spans two tasks' rows, so it may be short."""
    numbered = codes.withColumn("block", F.floor(F.col("pos") / CHUNK))
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.lpad(F.hex(x["code"]), 2, "0"))  # at most CHUNK
    chunks = numbered.groupBy("conv", "block").agg(F.unhex(F.array_join(held, "")).alias("codes")).withColumnRenamed("block", "chunk")
    many = chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("chunks")).filter("chunks > 1").withColumnRenamed("conv", "of")
    return chunks.join(many, F.col("conv").eqNullSafe(F.col("of")), "left").select("conv", "chunk", "codes", F.coalesce("chunks", F.lit(1)).alias("chunks"))


def _crossing(codes: pd.Series) -> pd.Series:
    return codes.map(lambda c: crossing(bytes(c)).ravel().tolist())


def _paths(codes: pd.Series, exits: pd.Series, last: pd.Series) -> pd.Series:
    """For each place at which a chunk may begin, its search with the price of its exits. The costs across it give the bound at which the search ends."""

    def each(rows: bytes, priced: list[int], ends: bool) -> list[dict]:
        own = _ending(WHOLE) if ends else priced
        bounds = (crossing(rows) + np.asarray(own)[None, :]).min(1)
        out = []
        for place in range(4):
            cost, audit, end = Search(rows, WHOLE if ends else priced, ends).run(place, int(bounds[place]))
            out.append({"cost": cost, "audit": audit, "end": end})
        return out

    return pd.Series([each(bytes(c), [int(v) for v in e], bool(z)) for c, e, z in zip(codes, exits, last, strict=True)])


def audits(chunks: DataFrame) -> DataFrame:
    """conv, chunk, codes, cost (of the whole conversation) and audit of each chunk."""
    short = chunks.filter("chunks = 1").withColumn("found", F.pandas_udf(_whole, "struct<cost: long, audit: string>")("codes")).select("conv", "chunk", "codes", "found.cost", "found.audit")
    kind = chunks.schema["conv"].dataType.simpleString()
    # A null conversation is one group here, as in every groupBy.
    long_ = chunks.filter("chunks > 1")
    exits = long_.select("conv", "chunk", F.pandas_udf(_crossing, "array<long>")("codes").alias("costs")).groupBy("conv").applyInPandas(_price, f"conv {kind}, chunk long, exits array<long>")
    last = F.max("chunk").over(W.partitionBy("conv"))
    same = lambda other: F.col("conv").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at"))
    priced = long_.withColumn("last", F.col("chunk") == last).join(exits.withColumnsRenamed({"conv": "of", "chunk": "at"}), same(exits)).drop("of", "at")
    searched = stored(priced.select("conv", "chunk", "codes", F.pandas_udf(_paths, "array<struct<cost: long, audit: string, end: int>>")("codes", "exits", "last").alias("paths")), "dialog-paths")
    linked = searched.select("conv", "chunk", "paths").groupBy("conv").applyInPandas(_link, f"conv {kind}, chunk long, cost long, audit string")
    long_ = searched.select("conv", "chunk", "codes").join(linked.withColumnsRenamed({"conv": "of", "chunk": "at"}), same(linked)).select("conv", "chunk", "codes", "cost", "audit")
    return short.unionByName(long_)


class _Report:
    """What is told of one conversation while its chunks, and then its rows, pass by in order."""

    def __init__(self, conv):
        self.conv, self.sha, self.begun = conv, hashlib.sha256(), False
        self.least = self.turn = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.codes, self.edits = bytearray(), bytearray()  # two bytes a row, as the audit itself is part of the result
        self.row, self.at, self.place = 0, 0, START

    def chunk(self, codes: bytes, edits: str, cost: int) -> None:
        self.codes += codes
        self.edits += edits.encode()
        self.cost = cost

    def _say(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.begun = True

    def _insert(self) -> None:
        while self.edits[self.at : self.at + 1] == b"I":
            self.place = _follows(self.place)
            self._say(ROLE[self.place], "")
            self.at += 1

    def take(self, turn: int | None, role: str, text: str) -> None:
        initial, fault = self.codes[self.row] % 4, self.codes[self.row] // 4
        self.row += 1
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.turn
            self.turn = turn
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL_PAIRS
        self.before = role[:1]
        self._insert()
        edit = chr(self.edits[self.at])
        self.at += 1
        if edit == "K":
            self.place = _kept(self.place, initial)
            self._say(role, text)
        elif edit == "R":
            self.place = _follows(self.place)
            self._say(ROLE[self.place], text)

    def told(self) -> tuple:
        self._insert()
        gaps = self.turn - self.least + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.edits.decode(), self.sha.hexdigest())


SEQUENCE = ["conv", "codes", "audit", "cost", "turn", "role", "text"]
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation from its chunks and rows in order; of the texts, only a batch is held."""
    report, out, kind = None, [], None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", *COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        kind, d = batch.schema.field("conv").type, batch.to_pydict()
        for conv, codes, audit, cost, turn, role, text in zip(*(d[n] for n in SEQUENCE), strict=True):
            if report is None or report.conv != conv:
                if report is not None:
                    out.append(report.told())
                report = _Report(conv)
            if codes is not None:
                report.chunk(codes, audit, cost)
            elif role is not None:
                report.take(turn, role, text)
        if len(out) >= 1000:
            yield packed(out)
            out = []
    if report is not None:
        out.append(report.told())
    if out:
        yield packed(out)


def repair(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each original conversation: its faults after damage, and the cost, the edits and the hash of its repair."""
    kind = rows.schema[conv].dataType.simpleString()
    with scratch(rows.sparkSession):
        hit = _ordered(damaged(rows, conv=conv, turn=turn, role=role, text=text))
        found = stored(audits(_chunked(stored(_coded(hit), "dialog-codes"))), "dialog-audits")
        there = F.col("copy").isNotNull()  # dropped rows only say that their conversation was there
        said = hit.select("conv", F.lit(None).cast("long").alias("chunk"), *ORDER, *[F.when(there, F.col(c)).alias(c) for c in ("role", "text")], F.lit(1).alias("kind"))
        both = said.unionByName(found.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        dealt = both.repartition("conv").sortWithinPartitions("conv", "kind", "chunk", *ORDER).select(*SEQUENCE)
        counts = ", ".join(f"{c} long" for c in COUNTS)
        got = dealt.mapInArrow(_told, f"conv {kind}, {counts}, audit string, repaired_sha256 string")
        return stored(got.withColumnRenamed("conv", conv), "dialogs", keep=True)
