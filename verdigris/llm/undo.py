"""Reassembly of a transaction log: savepoints, rollbacks, aborts and commits replayed into the states of a store.

A transaction's changes are a persistent list, each change a cell that points to the one before. A savepoint keeps the
list's head. A rollback walks from the head to the head that the last savepoint kept, telling each change that it undoes;
an abort walks to the end; a commit publishes what the list has.

Many sources write at once, each its transactions one after another, and one source may have most of the log. So records
are dealt by ranges of (source, seq), and every range is replayed on its own as if it began with a list it does not know:

* What a range undoes or publishes of its own changes, it tells at once. So it does with all transactions but two.
* Rollbacks that reach below the range's own savepoints, in the transaction that it began in, are told by number: they
  undo levels of the unknown list, the uppermost first.
* Changes left at the range's end are told as open, with their level: how many savepoints lie below them.

The ranges' summaries (a row for each range, so as many as the setting asks for) give the levels that each range starts
with, and so which later rollback, commit or abort decides an open change. However long a transaction is, no task has
more of it than its range.

Commits are numbered in log order, and published changes replayed by key: of each epoch of EPOCH commits the last value of
a key, beside the one that it replaces. States are running sums of those, again in ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import common_values, spread_join, staged, tune
from verdigris.operators.ordering import previous, running

#: Commits of an epoch.
EPOCH = 64
#: Kinds of the rows that a replayed range gives.
PUBLISHED, UNDONE, OPEN, OUTER, COMMIT, RANGE = range(6)
#: Records of a range, at most: numbers of records and commits are the range's number times this, plus a count.
SPAN = 1 << 33
_ROWS = 8192


class Cell(NamedTuple):
    """A change, and the list before it."""

    before: Cell | None
    at: int
    seq: int
    key: object
    value: object


def walk(head: Cell | None, until: Cell | None) -> Iterator[Cell]:
    """The cells from head back to, and without, the cell until."""
    while head is not until:
        yield head
        head = head.before


class Replay:
    """One range of the log, record by record; told has the rows that it gives, as (kind, at, source, seq, key, value, by, level).

    source is told of commits only, as those of equal seq are put in order by it.

    by is the number of the commit that published a change, or the seq of the record that undid it. level of an undone
    change is 1 for a rollback and 0 for an abort, that of an open one the savepoints of this range below it, that of an
    outer rollback how many came before it.
    """

    def __init__(self, part: int):
        self.part, self.n, self.commits, self.told = part, 0, 0, []
        self.source, self.first, self.started = None, None, False
        #: Whether the transaction may have begun in an earlier range, how many rollbacks reached below, and what ended it.
        self.inherits, self.outer, self.end = True, 0, None
        self.head, self.saves = None, []

    def undo(self, until: Cell | None, by: int | None, level: int) -> None:
        self.told.extend((UNDONE, c.at, None, c.seq, c.key, c.value, by, level) for c in walk(self.head, until))
        self.head = until

    def finish(self, how: str, seq: int | None, number: int | None) -> None:
        """The transaction is over."""
        if self.inherits:
            self.inherits, self.end = False, (how, seq, number)
        self.head, self.saves = None, []

    def record(self, source: object, seq: int, op: str, key: object, value: object) -> None:
        if not self.started:
            self.source = self.first = source
            self.started = True
        elif source != self.source:  # the log of the source before ends here
            self.undo(None, None, 0)
            self.finish("abort", None, None)
            self.source = source
        at = self.part * SPAN + self.n
        self.n += 1
        if op == "change":
            self.head = Cell(self.head, at, seq, key, value)
        elif op == "savepoint":
            self.saves.append(self.head)
        elif op == "rollback":
            if not self.saves and self.inherits:
                self.told.append((OUTER, self.part * SPAN + self.outer, None, seq, None, None, None, self.outer))
                self.outer += 1
            self.undo(self.saves.pop() if self.saves else None, seq, 1)
        elif op == "abort":
            self.undo(None, seq, 0)
            self.finish("abort", seq, None)
        elif op == "commit":
            number = self.part * SPAN + self.commits
            self.commits += 1
            self.told.append((COMMIT, at, source, seq, None, None, number, None))
            self.told.extend((PUBLISHED, c.at, None, c.seq, c.key, c.value, number, None) for c in walk(self.head, None))
            self.finish("commit", seq, number)

    def rest(self) -> None:
        """Tell what the range's end leaves open. A savepoint lies below the cells that are newer than the head it kept."""
        below = list(self.saves)
        for c in walk(self.head, None):
            while below and below[-1] is not None and below[-1].at >= c.at:
                below.pop()
            self.told.append((OPEN, c.at, None, c.seq, c.key, c.value, None, len(below)))


def replayed(log: DataFrame, parts: int) -> DataFrame:
    """kind, at, source, seq, key, value, by, level, range of every range of the log; range is set in the rows of kind RANGE only."""
    ordered = log.repartitionByRange(parts, "source", "seq").sortWithinPartitions("source", "seq", "op", "key", "value").withColumn("_part", F.spark_partition_id())
    kinds = {c: log.schema[c].dataType.simpleString() for c in ("source", "key", "value")}
    end = "struct<part: int, first: {0}, last: {0}, outer: int, saves: int, passes: boolean, how: string, seq: bigint, number: bigint>".format(kinds["source"])
    schema = f"kind int, at bigint, source {kinds['source']}, seq bigint, key {kinds['key']}, value {kinds['value']}, by bigint, level int, range {end}"
    names = ("kind", "at", "source", "seq", "key", "value", "by", "level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, r = None, None

        def out(rows: list, summary: dict | None = None) -> pa.RecordBatch:
            columns = dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}
            if summary:
                for n in names:
                    columns[n].append(RANGE if n == "kind" else None)
            n = len(columns["kind"])
            columns["range"] = [None] * (n - bool(summary)) + [summary] * bool(summary)
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in shape], schema=shape)

        for b in batches:
            if r is None and b.num_rows:
                r = Replay(b.column("_part")[0].as_py())
                of = {c: b.schema.field(c).type for c in ("source", "key", "value")}
                ends = [("part", pa.int32()), ("first", of["source"]), ("last", of["source"]), ("outer", pa.int32()), ("saves", pa.int32()), ("passes", pa.bool_()), ("how", pa.string()), ("seq", pa.int64()), ("number", pa.int64())]
                shape = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("source", of["source"]), ("seq", pa.int64()), ("key", of["key"]), ("value", of["value"]), ("by", pa.int64()), ("level", pa.int32()), ("range", pa.struct(ends))])
            for x in zip(*(b.column(c).to_pylist() for c in ("source", "seq", "op", "key", "value"))):
                r.record(*x)
                if len(r.told) >= _ROWS:
                    yield out(r.told)
                    r.told = []
        if r is not None:
            r.rest()
            how, seq, number = r.end or (None, None, None)
            yield out(r.told, {"part": r.part, "first": r.first, "last": r.source, "outer": r.outer, "saves": len(r.saves), "passes": r.inherits, "how": how, "seq": seq, "number": number})

    return ordered.select("source", "seq", "op", "key", "value", "_part").mapInArrow(run, schema)


class Fates:
    """What becomes of open changes, from the ranges' summaries in order."""

    def __init__(self, ranges: list):
        self.ranges = ranges
        self.at = {r.part: i for i, r in enumerate(ranges)}
        #: Open savepoints at the start of a range, those less its outer rollbacks, and whether the range before goes on in it.
        self.depth, self.left, self.goes_on, depth = [], [], [], 0
        for i, r in enumerate(ranges):
            self.goes_on.append(i > 0 and ranges[i - 1].last == r.first)
            depth = depth if self.goes_on[-1] else 0
            self.depth.append(depth)
            self.left.append(depth - r.outer)
            depth = (max(depth - r.outer, 0) if r.passes else 0) + r.saves

    def of(self, part: int, level: int) -> tuple[str, int | None, int | None, int | None]:
        """(how, seq, number, outer) of a change at a level of those of its range: the seq and number of what ends the
        transaction, or of a rollback its place among the outer ones."""
        i = self.at[part]
        level += max(self.left[i], 0) if self.ranges[i].passes else 0
        for q in range(i + 1, len(self.ranges)):
            r = self.ranges[q]
            if not self.goes_on[q]:
                break
            if self.left[q] < level:
                return "rollback", None, None, r.part * SPAN + self.depth[q] - level
            if not r.passes:
                return r.how, r.seq, r.number, None
        return "abort", None, None, None


class History(NamedTuple):
    """commits: number, seq, source of each; published: number, at, seq, key, value of the changes that a commit published;
    undone: kind (abort or rollback), seq, by (the record that undid it, null: the log's end), key, value."""

    commits: DataFrame
    published: DataFrame
    undone: DataFrame


def reassemble(log: DataFrame, parts: int | None = None) -> History:
    """The fates of all changes of log (source, seq, op, key, value); op is change, savepoint, rollback, abort or commit.

    Records of a source are in the order of seq, equal ones (repeated rows) in that of op, key and value. Null is a source
    like others. A null value deletes the key. Records of another op (or none), and those without a seq, which have no
    place in the log, are left out. value may be of any type that can be sorted. parts: how many ranges; else the session's number of shuffle partitions.
    """
    spark = log.sparkSession
    tune(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(log.select("source", F.col("seq").cast("bigint").alias("seq"), "op", "key", "value").filter(F.col("seq").isNotNull() & F.col("op").isin("change", "savepoint", "rollback", "abort", "commit")), "log")
    told = staged(replayed(rows, parts), "told")
    of = lambda kind: told.filter(F.col("kind") == kind)
    ranges = sorted((r["range"] for r in of(RANGE).select("range").collect()), key=lambda r: r.part)
    fates = Fates(ranges)

    def decide(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            got = {x: fates.of(*x) for x in set(zip(pdf["at"] // SPAN, pdf["level"]))}
            each = [got[x] for x in zip(pdf["at"] // SPAN, pdf["level"])]
            how, seq, number, outer = ([x[i] for x in each] for i in range(4))
            whole = lambda x: pd.array(x, "Int64")
            yield pd.DataFrame({"at": pdf["at"], "how": how, "by": whole(seq), "number": whole(number), "outer": whole(outer)})

    opened = of(OPEN)
    decided = staged(opened.select("at", "level").mapInPandas(decide, "at bigint, how string, by bigint, number bigint, outer bigint").join(opened.select("at", "seq", "key", "value"), "at"), "decided")
    published = of(PUBLISHED).select(F.col("by").alias("number"), "at", "seq", "key", "value").unionByName(decided.filter("how = 'commit'").select("number", "at", "seq", "key", "value"))
    counts = decided.filter("how = 'rollback'").groupBy("outer").agg(F.count("*").alias("n"))
    rolled = decided.filter("how = 'rollback'").select("outer", "seq", "key", "value")
    rolled = spread_join(rolled, of(OUTER).select(F.col("at").alias("outer"), F.col("seq").alias("by")), "outer", common_values(counts, "outer"))
    kind = F.when(F.col("level") == 1, "rollback").otherwise("abort")
    undone = of(UNDONE).select(kind.alias("kind"), "seq", "by", "key", "value")
    undone = undone.unionByName(decided.filter("how = 'abort'").select(F.lit("abort").alias("kind"), "seq", "by", "key", "value"))
    undone = undone.unionByName(rolled.select(F.lit("rollback").alias("kind"), "seq", "by", "key", "value"))
    return History(of(COMMIT).select(F.col("by").alias("number"), "seq", "source"), published, undone)


def versions(history: History, epoch: int = EPOCH) -> tuple[DataFrame, DataFrame]:
    """Epochs (epoch from 1, commits), and key, epoch, value, replaced: each key's last value of the epochs that change it.

    Commits count in the order of seq, equal ones by source; changes of a commit in log order. value null: deleted;
    replaced null: there was none. A commit of any number of changes is spread over all tasks, and so is a key.
    """
    ranked = staged(running(history.commits.withColumn("one", F.lit(1).cast("bigint")), ["seq", "source", "number"], {"rank": "one"}).select("number", "rank", (F.floor(F.col("rank") / epoch) + 1).cast("bigint").alias("epoch")), "ranked")
    counts = history.published.groupBy("number").agg(F.count("*").alias("n"))
    placed = spread_join(history.published, ranked, "number", common_values(counts, "number"))
    last = placed.groupBy("key", "epoch").agg(F.max_by(F.struct("value"), F.struct("rank", "at")).alias("last")).select("key", "epoch", "last.value")
    return ranked.groupBy("epoch").agg(F.count("*").alias("commits")), previous(last, "key", "epoch", "value", "replaced")


def states(epochs: DataFrame, changed: DataFrame) -> DataFrame:
    """epoch, keys, total after each epoch: how many keys are stored, and the sum of their values (bigint), 0 of none."""
    here = lambda c: F.col(c).isNotNull().cast("bigint")
    own = changed.groupBy("epoch").agg(F.sum(here("value") - here("replaced")).alias("more"), F.sum(F.coalesce("value", F.lit(0)) - F.coalesce("replaced", F.lit(0))).alias("gain"))
    all_of = epochs.select("epoch").join(own, "epoch", "left").select("epoch", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("gain", F.lit(0)).alias("gain"))
    return running(all_of, ["epoch"], {"keys": "more", "total": "gain"}).select("epoch", (F.col("keys") + F.col("more")).alias("keys"), (F.col("total") + F.col("gain")).alias("total"))


#: What a document's hash, modulo 17, makes of it as a log record; from 7 on it is a change.
OPS = ("commit", "commit", "abort", "savepoint", "savepoint", "rollback", "rollback")


def as_log(docs: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents as log records: source, seq (the key), op, key and value (CRC-32 of "key:text"; null: deleted) of changes.

    Null texts and texts that marks (key, toxic) has as toxic once or more delete. A digest in place of the text is all
    that the states need, so texts are neither sorted nor shuffled.
    """
    toxic = marks.filter("toxic = 1").select(F.col(key).alias("_toxic")).distinct()
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    op = F.coalesce(F.get(F.array(*map(F.lit, OPS)), (F.col("_h") % 17).cast("int")), F.lit("change"))
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(source).alias("source"), F.col(key).alias("seq"), h.alias("_h"), F.col(text).alias("_text"))
    rows = rows.withColumns({"op": op, "key": F.when(F.col("_h") % 17 >= len(OPS), (F.floor(F.col("_h") / 100) % 30000).cast("bigint"))})
    rows = rows.withColumn("value", F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), "_text").cast("binary")))
    return rows.drop("_h", "_text").join(toxic, F.col("seq") == F.col("_toxic"), "left").withColumn("value", F.when(F.col("_toxic").isNull(), F.col("value"))).drop("_toxic")


def digest(log: DataFrame, epoch: int = EPOCH, parts: int | None = None) -> DataFrame:
    """kind, id, n, value: `state`, epoch, keys, total of each epoch, and kind, seq, undoing seq, key of every undone change.

    An empty log, or one without a commit, has no states. See reassemble() for nulls, ties and repeated rows.
    """
    history = reassemble(log, parts)
    after = states(*versions(history, epoch)).select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), F.col("keys").alias("n"), F.col("total").alias("value"))
    return after.unionByName(history.undone.select("kind", F.col("seq").alias("id"), F.col("by").alias("n"), F.col("key").cast("bigint").alias("value")))


def oracle(epoch: int = EPOCH) -> str:
    """The rows of digest(as_log(documents, labels)) by SQL, where doc_id is unique.

    A change's level is the number of open savepoints, a walk that rollbacks do not take below 0; the next rollback at its
    level undoes it.
    """

    def crc(text: str) -> str:
        """CRC-32 of a text, byte by byte through the table t."""
        octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
        return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"

    return (
        "WITH octet AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) t), "
        f"h AS (SELECT doc_id, source, text, {crc('doc_id::VARCHAR')} h FROM documents, octet WHERE doc_id IS NOT NULL), k AS (SELECT doc_id, source, text, h % 17 m, h // 100 % 30000 k FROM h), "
        "r AS (SELECT doc_id, source, k, CASE WHEN m < 2 THEN 'commit' WHEN m = 2 THEN 'abort' WHEN m < 5 THEN 'savepoint' WHEN m < 7 THEN 'rollback' ELSE 'change' END op, "
        f"CASE WHEN m > 6 AND text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) THEN {crc('''k || ':' || text''')} END v FROM k, octet), "
        "x AS (SELECT *, count(*) FILTER (op IN ('commit', 'abort')) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) tx FROM r), "
        "s AS (SELECT *, sum(CASE op WHEN 'savepoint' THEN 1 WHEN 'rollback' THEN -1 ELSE 0 END) OVER (PARTITION BY source, tx ORDER BY doc_id) s FROM x), "
        "o AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY source, tx ORDER BY doc_id)) depth FROM s), "
        "l AS (SELECT *, CASE WHEN op = 'rollback' THEN coalesce(lag(depth) OVER (PARTITION BY source, tx ORDER BY doc_id), 0) ELSE depth END level FROM o), "
        "u AS (SELECT *, min(doc_id) FILTER (op = 'rollback') OVER (PARTITION BY source, tx, level ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) back, max(CASE WHEN op IN ('commit', 'abort') THEN doc_id END) OVER (PARTITION BY source, tx) done, max(CASE WHEN op = 'commit' THEN doc_id END) OVER (PARTITION BY source, tx) pub FROM l), "
        f"c AS (SELECT doc_id pub, (row_number() OVER (ORDER BY doc_id) - 1) // {epoch} + 1 ep FROM r WHERE op = 'commit'), "
        "p AS (SELECT k, ep, max_by(struct_pack(v := v), (pub, doc_id)).v v FROM u JOIN c USING (pub) WHERE op = 'change' AND back IS NULL GROUP BY ALL), "
        "g AS (SELECT ep, (v IS NOT NULL)::INT - (lag(v) OVER w IS NOT NULL)::INT dn, coalesce(v, 0) - coalesce(lag(v) OVER w, 0) dv FROM p WINDOW w AS (PARTITION BY k ORDER BY ep)), "
        "e AS (SELECT ep, coalesce(sum(dn), 0) dn, coalesce(sum(dv), 0) dv FROM (SELECT DISTINCT ep FROM c) LEFT JOIN g USING (ep) GROUP BY ep) "
        "SELECT 'state' kind, ep::BIGINT id, sum(dn) OVER (ORDER BY ep)::BIGINT n, sum(dv) OVER (ORDER BY ep)::BIGINT value FROM e "
        "UNION ALL SELECT CASE WHEN back IS NULL THEN 'abort' ELSE 'rollback' END, doc_id, coalesce(back, done), k FROM u WHERE op = 'change' AND (back IS NOT NULL OR pub IS NULL)"
    )
