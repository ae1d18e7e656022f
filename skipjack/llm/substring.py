"""Substring deduplication with a log-structured fingerprint index.

A word goes if a window of 13 words that covers it also starts in a document with a smaller doc_id.

1. Profile: one pass over the texts gives a digest of the words, and the winnowed fingerprints: a window's anchor is the
   least hash of its 6-word grams, so equal windows have equal anchors and neighbouring windows share theirs (about two
   anchors come from nine words). Documents whose words equal an earlier document's lose every word and go no further.
2. Folding: anchors that several rows of one Arrow batch share are known to be shared there and then, and one row of the
   batch stands for them, so a passage in a third of all documents makes one posting a batch.
3. Log-structured index. A batch's postings become a run: (h, call, row), hash-bucketed and sorted by h, never changed after
   it is written. Each new run is merge-joined with the runs before it (buckets line up, so no run is shuffled); an
   anchor met in two rows is shared. Once there are more than ``fan_in`` runs they are compacted into one. An
   index that is passed in outlives the call: it also keeps the texts and digests of each call, against which later calls
   are verified. All it holds counts as earlier than what comes in, whatever the doc_ids; a document comes in one call.
   Its folder holds a manifest, written when a call is whole, from which a later session opens it again; a call that breaks off
   leaves what the manifest says.
4. Verification. Only windows whose anchor is shared are looked at again, by a 128-bit hash of their words. A task first
   settles what it can among its own documents and sends one row per window, so a passage in a third of all documents
   makes a row per task, not per document. Nothing rests on the 64-bit anchors.
5. Removal on the original text, by character spans.

Defined cases: null and blank texts have no words; texts under 13 words have no window; rows that repeat a doc_id
belong to one document but their windows do not span rows, and each row is returned; null doc_ids sort before all
others, as one document; other columns are ignored; an empty table gives an empty result. The input is read twice and must give the same rows in the same
partitions (files do); otherwise the job stops with an error.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skipjack.llm.common import BROADCAST_ROWS, as_bytes, forget, join_unique, read_version, release, remove, scratch, shared_dir, slices, stored, write_version
from skipjack.llm.windows import Words

WINDOW, GRAM = 13, 6
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Stands for a null doc_id, below all others.
NO_DOC = -(2**63)
#: Row number of the documents of earlier calls, below all others.
OLD = -1
MANIFEST = "manifest"


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fan_in: int = 4):
        """path: the folder of an index that is kept, opened again if it holds one; none: scratch."""
        self.spark, self.fan_in = spark, fan_in
        self.path = (path or scratch(spark, "window-index")).rstrip("/")
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[str] = []
        self.count = 0
        #: Of each earlier call: folders of the digests (a, b, n_words) and texts (row, text) of its documents with windows, and of the
        #: anchors (h, row) for which another row stands in a run.
        self.calls: list[tuple[str, str, str]] = []
        self.shape: tuple[int, int] | None = None
        #: Folders that the manifest may still name.
        self.merged: list[str] = []
        self.reload()

    def reload(self) -> None:
        """What the manifest says; nothing if there is none."""
        found = read_version(self.spark, f"{self.path}/{MANIFEST}")
        self.version = found[0] if found else -1
        own = json.loads(found[1]) if found else {"runs": [], "count": 0, "calls": [], "shape": None, "buckets": self.buckets}
        self.runs, self.count, self.buckets = own["runs"], own["count"], own["buckets"]
        self.calls, self.shape, self.merged = [tuple(c) for c in own["calls"]], own["shape"] and tuple(own["shape"]), []
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
            self.spark.sql(f"CREATE TABLE {self._name(run)} (h BIGINT, call INT, row BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")

    def commit(self) -> None:
        """Write the manifest; then what it no longer names can go."""
        self.version += 1
        write_version(self.spark, f"{self.path}/{MANIFEST}", self.version, json.dumps({"runs": self.runs, "count": self.count, "calls": self.calls, "shape": self.shape, "buckets": self.buckets}))
        for run in self.merged:
            remove(self.spark, f"{self.path}/{run}")
        self.merged = []

    def _name(self, run: str) -> str:
        return "skipjack_" + re.sub(r"\W", "_", f"{self.path}/{run}")[-80:]

    def _write(self, rows: DataFrame) -> str:
        run = f"run-{self.count:05d}"
        self.count += 1
        name = self._name(run)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        rows.repartition(self.buckets, "h").write.option("path", f"{self.path}/{run}").bucketBy(self.buckets, "h").sortBy("h").mode("overwrite").saveAsTable(name)
        return run

    def postings(self, shared: DataFrame | None = None) -> DataFrame:
        """(h, call, row) of all runs, or of the given anchors; each run is joined where its buckets lie."""
        out = None
        for run in self.runs:
            own = self.spark.table(self._name(run))
            own = own if shared is None else own.join(shared, "h")
            out = own if out is None else out.unionByName(own)
        return out.select("h", "call", "row")

    def drop(self) -> None:
        """Remove the whole index."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
        self.runs, self.calls, self.merged, self.shape = [], [], [], None
        remove(self.spark, self.path)

    def keep(self, digests: DataFrame, texts: DataFrame, folded: DataFrame) -> None:
        """Store a call's documents, for the verification of later calls."""
        own = tuple(f"{kind}-{len(self.calls):05d}" for kind in ("digests", "texts", "folded"))
        for rows, folder in zip((digests, texts, folded), own, strict=True):
            rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self.calls.append(own)

    def digests(self) -> DataFrame | None:
        """(a, b, n_words) of all documents of earlier calls."""
        if not self.calls:
            return None
        return self.spark.read.schema("a long, b long, n_words long").parquet(*[f"{self.path}/{d}" for d, _, _ in self.calls])

    def texts(self, call: int) -> DataFrame:
        """(row, text) of a call."""
        return self.spark.read.schema("row long, text string").parquet(f"{self.path}/{self.calls[call][1]}")

    def folded(self, call: int, shared: DataFrame) -> DataFrame:
        """(row, h) of a call's rows for which others stand, of the given anchors."""
        rows = self.spark.read.schema("h long, row long").parquet(f"{self.path}/{self.calls[call][2]}")
        counted = stored(rows.groupBy("h").agg(F.count("*").alias("n")).join(shared, "h"), "folded-anchors")
        return join_unique(rows, counted, ["h"]).select("row", "h")

    def append(self, postings: DataFrame) -> DataFrame:
        """Add a batch's (h, call, row); return the anchors it shares or makes shared (h, one row each)."""
        run = self._write(postings.select("h", F.col("call").cast("int").alias("call"), "row"))
        new = self.spark.table(self._name(run))
        shared = new.groupBy("h").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("h")
        for old in self.runs:
            # The merge join of keys: both sides are bucketed and sorted by h.
            keys = new.select("h").distinct()
            shared = shared.unionByName(keys.join(self.spark.table(self._name(old)).select("h").distinct().hint("merge"), "h"))
        self.runs.append(run)
        found = stored(shared.distinct() if len(self.runs) > 1 else shared, "shared-anchors")
        if len(self.runs) > self.fan_in:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs into one; the old ones go when no manifest names them."""
        old, merged = self.runs, self._write(self.postings())
        self.runs = [merged]
        for run in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
        self.merged += old

    def sweep(self) -> None:
        """Remove merged runs of an index without a manifest."""
        for run in self.merged:
            remove(self.spark, f"{self.path}/{run}")
        self.merged = []


def profile(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text, row) -> doc_id, row, n_words, digest of the words (a, b), their sha256, distinct anchors h."""
    kind = pa.list_(pa.int64())

    def run(batches):
        import xxhash

        for batch in batches:
            for part in slices(batch, "text"):
                texts = as_bytes(part.column("text"))
                words = Words(texts)
                places, low = words.anchors(size, gram)
                owner = words.text_of[places]
                if len(low):  # windows in a row mostly share theirs; then the rest
                    for sort in (False, True):
                        if sort:
                            order = np.lexsort((low, owner))
                            low, owner = low[order], owner[order]
                        new = np.concatenate(([True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])))
                        low, owner = low[new], owner[new]
                offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                lines = [b" ".join(t.split()) for t in texts]
                pair = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.int64).reshape(-1, 2)
                arrays = [part.column("doc_id"), part.column("row"), pa.array(np.diff(words.bounds)), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array([hashlib.sha256(x).hexdigest() for x in lines]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(low.view(np.int64))).cast(kind)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "n_words", "a", "b", "sha", "h"])

    return docs.mapInArrow(run, "doc_id long, row long, n_words long, a long, b long, sha string, h array<long>")


def fold(profiles: DataFrame) -> DataFrame:
    """profiles(doc_id, row, h) -> doc_id, row, post (anchors the row stands for in its Arrow batch), own (anchors it shares there)."""
    kind = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            lists = batch.column("h")
            h = lists.flatten().to_numpy(zero_copy_only=False)
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), size)
            order = np.argsort(h, kind="stable")
            new = np.concatenate(([True], h[order][1:] != h[order][:-1]))[: len(h)]
            several = np.diff(np.append(np.flatnonzero(new), len(h)))[np.cumsum(new) - 1] > 1 if len(h) else new
            cols = []
            for kept in (new, several):
                mark = np.zeros(len(h), bool)
                mark[order] = kept
                offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[mark], minlength=batch.num_rows))))
                cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[mark])).cast(kind))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *cols], names=["doc_id", "row", "post", "own"])

    return profiles.select("doc_id", "row", "h").mapInArrow(run, "doc_id long, row long, post array<long>, own array<long>")


def _marks(held: DataFrame, size: int, gram: int) -> DataFrame:
    """held(doc_id, row, text, shared) -> (row, at): windows that also start in an earlier document.

    Rows of earlier calls have row OLD; they come before all others and get no marks. Rows sent on: the task's first document
    of each window (a, b, doc_id, row, at), and what is already known to be late (a random, b null).
    """

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            keys, docs, rows, ats = [], [], [], []
            for part in slices(batch, "text"):
                words = Words(as_bytes(part.column("text")))
                places, low = words.anchors(size, gram)
                owner = words.text_of[places]
                lists = part.column("shared")
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                keep = np.zeros(len(places), bool)
                for k in range(part.num_rows):
                    keep[cuts[k] : cuts[k + 1]] = np.isin(low[cuts[k] : cuts[k + 1]], flat[offsets[k] : offsets[k + 1]])
                places, owner = places[keep], owner[keep]
                # Words with one space between them: a window is a slice of these bytes.
                line = b" ".join(words.whole.split())
                sizes = words.ends - words.starts
                begin = np.cumsum(sizes + 1) - sizes - 1
                keys.append(b"".join([digest(line[s:e]) for s, e in zip(begin[places].tolist(), (begin + sizes)[places + size - 1].tolist(), strict=True)]))
                docs.append(part.column("doc_id").to_numpy(zero_copy_only=False)[owner])
                rows.append(part.column("row").to_numpy(zero_copy_only=False)[owner])
                ats.append((places - words.bounds[owner]).astype(np.int32))
            if not keys:
                continue
            pair = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            a, b, doc, row, at = pair[:, 0], pair[:, 1], np.concatenate(docs), np.concatenate(rows), np.concatenate(ats)
            order = np.lexsort((doc, row != OLD, b, a))
            a, b, doc, row, at = a[order], b[order], doc[order], row[order], at[order]
            fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
            old = row == OLD
            late = np.where(old[first], ~old, doc > doc[first])
            sent = ~old | fresh
            a, b, doc, row, at, late = a[sent], b[sent], doc[sent], row[sent], at[sent], late[sent]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(late, row * 31 + at, a)), pa.array(b, mask=late), pa.array(doc), pa.array(row), pa.array(at)], names=["a", "b", "doc_id", "row", "at"])

    sent = held.mapInArrow(run, "a long, b long, doc_id long, row long, at int")
    same = Window.partitionBy("a", "b")
    marked = sent.withColumn("first", F.min("doc_id").over(same)).withColumn("least", F.min("row").over(same))
    return marked.where(f"row <> {OLD} and (b is null or least = {OLD} or doc_id > first)").select("row", "at")


def cut(text: str, starts: np.ndarray, size: int) -> tuple[int, int, list[dict], str, str]:
    """(words, removed, spans, kept words joined by a space, text without the spans)."""
    places = [m.span() for m in WORD.finditer(text)]
    change = np.zeros(len(places) + size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    gone = np.cumsum(change[: len(places)]) > 0
    numbers = np.flatnonzero(gone)
    spans = []
    if len(numbers):
        for run in np.split(numbers, np.flatnonzero(np.diff(numbers) > 1) + 1):
            last = int(run[-1])
            spans.append({"start": places[run[0]][0], "end": places[last + 1][0] if last + 1 < len(places) else places[last][1]})
    left, at = [], 0
    for s in spans:
        left.append(text[at : s["start"]])
        at = s["end"]
    left.append(text[at:])
    kept = " ".join([text[a:b] for (a, b), g in zip(places, gone.tolist(), strict=True) if not g])
    return len(places), len(numbers), spans, kept, "".join(left) if spans else text


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _removed(held: DataFrame, size: int) -> DataFrame:
    """held(row, text, starts) -> the text's row of results."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                cols: list[list] = [[], [], [], []]
                for text, starts in zip(part.column("text").to_pylist(), part.column("starts").to_pylist(), strict=True):
                    _, gone, spans, kept, left = cut(text or "", np.array(starts, np.int64), size)
                    for c, v in zip(cols, (gone, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), spans, left), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.string(), SPANS, pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["row", "gone", "kept", "cut_spans", "cut_text"])

    return held.select("row", "text", "starts").mapInArrow(run, "row long, gone long, kept string, cut_spans array<struct<start:int,end:int>>, cut_text string")


def deduplicate_substrings(docs: DataFrame, index: FingerprintIndex | None = None, batches: int = 2, size: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, row_col: str | None = None) -> DataFrame:
    """doc_id, row, n_words, n_removed, kept_sha256, spans (cut from the text; null: all of it) and, on demand, kept_text.

    `row` is row_col (distinct numbers from 0 on) or else numbers the rows of docs (monotonically_increasing_id over its partitions). With an index, what earlier calls
    put in it counts as earlier than docs.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    if index is None:
        own = FingerprintIndex(spark)
        try:
            return _deduplicated(docs, own, False, batches, size, gram, id_col, text_col, with_text, row_col)
        finally:
            own.drop()
    if index.shape not in (None, (size, gram)):
        raise ValueError(f"the index holds windows of {index.shape} words, not {(size, gram)}")
    index.shape = size, gram
    try:
        out = _deduplicated(docs, index, True, batches, size, gram, id_col, text_col, with_text, row_col)
    except BaseException:
        index.reload()
        raise
    index.commit()
    return out


def _deduplicated(docs: DataFrame, index: FingerprintIndex, kept: bool, batches: int, size: int, gram: int, id_col: str, text_col: str, with_text: bool, row_col: str | None) -> DataFrame:
    spark = docs.sparkSession
    earlier = index.digests()
    call = len(index.calls)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_DOC)).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()).alias("row"))
    path = scratch(spark, "profiles")
    profile(texts, size, gram).write.parquet(path)
    full = spark.read.parquet(path)
    seen = stored(full.drop("h"), "digests")
    windowed = seen.where(F.col("n_words") >= size).select("doc_id", "row", "a", "b", "n_words")
    # Whole copies of an earlier document: every window of theirs starts in it.
    key = ["a", "b", "n_words"]
    groups = windowed.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    firsts = stored(groups.where("first < last").drop("last"), "first-copies")
    copied = join_unique(windowed, firsts, key).where("doc_id > first").select("row")
    if earlier is not None:
        known = stored(groups.select(*key, "n").join(earlier.select(*key).distinct(), key), "known-copies")
        copied = copied.unionByName(join_unique(windowed, known, key).select("row")).distinct()
    copies = stored(copied, "copies")
    forget(firsts)
    # Sent around only while their checked number is small; otherwise joined by a shuffle.
    sent = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    single = stored(fold(full.where(F.col("n_words") >= size).select("doc_id", "row", "h").join(sent, "row", "left_anti")), "postings")
    remove(spark, path)
    del full
    # Batches by doc_id: each becomes a run and meets the runs before it.
    edges = [] if batches < 2 else windowed.where(F.col("doc_id") != NO_DOC).select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    edges = sorted(set(edges))
    if kept:  # before the anchors: a run without texts could not be verified
        own = windowed.join(sent, "row", "left_anti")
        index.keep(own.select("a", "b", "n_words"), texts.join(own.select("row"), "row"), single.select(F.explode("own").alias("h"), "row"))
        if index.texts(call).count() != own.count():
            raise RuntimeError("the source gave other partitions on its second reading; store it first")
    found = []
    for k in range(len(edges) + 1):
        batch = single
        if k:
            batch = batch.where(F.col("doc_id") > edges[k - 1])
        if k < len(edges):
            batch = batch.where(F.col("doc_id") <= edges[k])
        found.append(index.append(batch.select(F.explode("post").alias("h"), F.lit(call).alias("call"), "row")))
        if not kept:
            index.sweep()
        release(spark)
    shared = found[0]
    for more in found[1:]:
        shared = shared.unionByName(more)
    shared = shared.distinct() if edges else shared
    # Unique keys on the right: a frequent anchor makes one row per Arrow batch that has it.
    met = index.postings(shared)
    met = stored(met, "shared-postings") if call else met
    now = met.where(F.col("call") == call).groupBy("row").agg(F.collect_set("h").alias("shared"))
    now = now.unionByName(single.where(F.size("own") > 0).select("row", F.col("own").alias("shared")))
    lists = stored(now.groupBy("row").agg(F.flatten(F.collect_list("shared")).alias("shared")), "shared-by-row")
    shared = stored(shared, "shared-anchors") if call else shared
    old = None
    for k in range(call):
        wanted = met.where(F.col("call") == k).select("row", "h").unionByName(index.folded(k, shared)).groupBy("row").agg(F.collect_set("h").alias("shared"))
        part = index.texts(k).join(wanted, "row").select(F.lit(NO_DOC).alias("doc_id"), F.lit(OLD).cast("long").alias("row"), "text", "shared")
        old = part if old is None else old.unionByName(part)
    old = None if old is None else stored(old, "earlier-texts")
    forget(*found, single, *([met, shared] if call else []))
    if not kept:
        index.drop()
    release(spark)
    held = stored(texts.join(lists, "row"), "texts")
    if held.count() != lists.count():
        raise RuntimeError("the source gave other partitions on its second reading; store it first")
    forget(lists)
    release(spark)
    compared = held.select("doc_id", "row", "text", "shared")
    starts = stored(_marks(compared if old is None else compared.unionByName(old), size, gram).groupBy("row").agg(F.collect_set("at").alias("starts")), "removals")
    release(spark)
    removed = _removed(held.select("row", "text").join(starts, "row"), size)
    removed = stored(removed if with_text else removed.drop("cut_text"), "removed")
    forget(held, starts, *([] if old is None else [old]))
    release(spark)
    nothing = hashlib.sha256(b"").hexdigest()
    out = seen.select("doc_id", "row", "n_words", "sha").join(copies.withColumn("copy", F.lit(True)), "row", "left").join(removed, "row", "left")
    no_span = F.array().cast("array<struct<start:int,end:int>>")
    out = out.select(
        F.when(F.col("doc_id") != NO_DOC, F.col("doc_id")).alias("doc_id"),
        "row",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit(None)).otherwise(F.coalesce("cut_spans", no_span)).alias("spans"),
        *([F.when(F.col("copy"), F.lit("")).otherwise(F.col("cut_text")).alias("cut_text")] if with_text else []),
    )
    if not with_text:
        return out
    # The columns of the first reading, so that the rows are numbered alike.
    whole = texts.withColumnRenamed("doc_id", "key").join(out.withColumn("key", F.coalesce("doc_id", F.lit(NO_DOC))), ["row", "key"]).drop("key")
    return whole.withColumn("kept_text", F.coalesce("cut_text", "text")).drop("cut_text", "text")
