"""The chunk store: immutable Parquet files under committed manifests, upserted by chunk id.

An upsert reads only files that may hold one of its ids or filings, as a filter and a table of filings of each file tell, and
writes what it changes beside them; one rename of a manifest makes it the current version. Readers keep the version they
opened. Counts of companies, forms, filings and tables come from what is kept of the files, without a row being read; with each
commit go its postings and the differences that it makes to document frequencies and lengths (``gneiss.operators.postings``).

The manifest is a line a file on the driver; at 128 MB a file that is some 100 MB for 100 TB.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.functions.columns import free
from gneiss.functions.sizes import if_small
from gneiss.functions.text import metadata_value
from gneiss.operators import postings as P
from gneiss.operators.vector import Embedder, embed
from gneiss.schemas import CHUNK_COLUMNS, STORED
from gneiss.sources.snapshots import Conflict, File, Manifest, Part, Versions

STORED_COLUMNS = [c.split()[0] for c in STORED.split(", ")]
#: What is kept of each file: chunks and tables of each filing in it, and a filter of its chunk ids.
FILINGS = "file string, ticker string, form string, accession_number string, chunks bigint, tables bigint, first bigint, last bigint"
FILTERS = "file string, bits binary"
#: Rows of a file, bits of a filter for each of them, places that an id sets.
FILE_ROWS, BITS_A_ROW, PLACES = 200_000, 10, 4
#: Ids of a batch that are sent to the filters; of larger batches every file is looked at.
PROBED_IDS = 1_000_000
#: Bytes of bits that tell replaced chunks, sent to the tasks that read files again.
MARKED_BYTES = 32 << 20
#: Times that an upsert begins anew on what another writer committed meanwhile.
TRIES = 4


def usable(batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows with a key and a text: one of more than spaces, also those of other widths (Unicode's Zs)."""
    return batch.where((F.coalesce(F.col(key), F.lit("")) != "") & F.coalesce("text", F.lit("")).rlike(r"[^\p{Zs}]"))


def last_wins(batch: DataFrame, key: str = "chunk_id", order: str = "seq", first: str | None = None) -> DataFrame:
    """One row for each key, the one latest by ``order``; rows without key or text are left out.

    The column ``first``, if one is asked for, has the least ``order`` of the key: a key that comes again keeps its place.
    """
    own = free(batch, "n")
    rows = Window.partitionBy(key)
    kept = usable(batch, key)
    kept = kept.withColumn(first, F.min(order).over(rows)) if first else kept
    return kept.withColumn(own, F.row_number().over(rows.orderBy(F.desc(order)))).where(F.col(own) == 1).drop(own)


def not_replaced(rows: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows whose key ``batch`` does not have."""
    return rows.join(batch.select(key), key, "left_anti")


def place_of_mark() -> Column:
    return F.bitmap_bucket_number(F.col("corpus_pos") + 1)


def marks(ended: DataFrame, positions: int) -> DataFrame:
    """(_mark, _bits): corpus positions as bits, 32,768 to a row; sent out while all positions take at most MARKED_BYTES."""
    bits = ended.groupBy(place_of_mark().alias("_mark")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("corpus_pos") + 1)).alias("_bits"))
    return F.broadcast(bits) if positions <= 8 * MARKED_BYTES else bits


def is_marked() -> Column:
    """Whether the bit of a row's corpus_pos is set in _bits, which may be missing."""
    bit = F.bitmap_bit_position(F.col("corpus_pos") + 1)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """``rows``, which come from files written in order, with corpus_pos counted on from ``first``.

    ``_at`` is their place in a written partition, as monotonically_increasing_id tells it; only the
    counts of the partitions meet, so no task counts through a whole company.
    """
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    place = F.lit(first) + F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(base, part == F.col("_part")).withColumn("corpus_pos", place.cast("long")).drop("_at", "_part", "_base")


def companies(chunks: DataFrame) -> DataFrame:
    """Per ticker: chunks, distinct filings and forms."""
    return (
        chunks.where(F.coalesce("ticker", F.lit("")) != "").groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("chunks"),
            F.count_distinct(F.nullif("accession_number", F.lit(""))).alias("filings"),
            F.sort_array(F.collect_set(F.nullif("form", F.lit("")))).alias("forms"),
        )
    )


def table_counts(chunks: DataFrame) -> DataFrame:
    """One row: how many chunks are tables, and how many prose."""
    is_table = F.coalesce(F.col("chunk_type") == "table", F.lit(False))
    return chunks.agg(F.count_if(is_table).alias("tables"), F.count_if(~is_table).alias("prose"))


def stats(chunks: DataFrame) -> DataFrame:
    """One row over the whole store; zeros and empty lists when it is empty."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sort_array(F.collect_set(F.nullif("ticker", F.lit("")))).alias("tickers"),
        F.sort_array(F.collect_set(F.nullif("form", F.lit("")))).alias("forms"),
        F.count_distinct(F.nullif("accession_number", F.lit(""))).alias("filings"),
    )


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(id, place): the bits of a filter that each 64-bit hash sets."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(PLACES, dtype=np.uint64)) % np.uint64(bits)


def id_filter(hashes: np.ndarray) -> bytes:
    """A Bloom filter of 64-bit hashes, BITS_A_ROW bits for each."""
    bits = np.zeros(max(len(hashes) * BITS_A_ROW, 64) + 7 & ~7, bool)
    bits[_places(hashes, len(bits))] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> bool:
    """Whether any of the hashes may be in the filter."""
    whole = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
    return any(bool(whole[_places(hashes[at : at + 65536], len(whole))].all(axis=1).any()) for at in range(0, len(hashes), 65536))


class Store:
    """A folder of chunks; ``corpus_pos`` keeps the order in which chunks first came, over the whole store.

    Terms are stored with their chunks, and vectors too where the store has an embedder, so that
    questions read neither texts nor models.
    """

    def __init__(self, spark: SparkSession, path: str, reset: bool = False, embedder: Embedder | None = None, buckets: int = 16):
        self.spark, self.path, self.embedder, self.buckets = spark, path.rstrip("/"), embedder, buckets
        self.versions = Versions(spark, self.path)
        if reset:
            self.versions.delete()

    def exists(self) -> bool:
        return bool(self.versions.numbers())

    def manifest(self, version: int | None = None) -> Manifest:
        return self.versions.read(version)

    def is_whole(self, version: int) -> bool:
        """Whether ``version`` is there with all files and folders that its manifest names; no row is read."""
        if version not in self.versions.numbers():
            return False
        manifest = self.manifest(version)
        named = {f"{table}/part={p.name}" for p in manifest.parts for table in ("postings", "terms", "totals")}
        named |= {f"dead/part={p.name}" for p in manifest.parts if p.dead}
        named |= {f"{table}/{f.path.split('/')[1]}" for f in manifest.files for table in ("filings", "filters")} | {f.path for f in manifest.files}
        held = {below: set(self.versions.folders(below)) for below in {n.rpartition("/")[0] for n in named}}
        return all(name in held[below] for below, _, name in (n.rpartition("/") for n in named))

    # -- reading ---------------------------------------------------------------------------

    def scan(self, ticker: str | None = None, version: int | None = None) -> DataFrame:
        """All chunks, or those of one company: only its files are read. An earlier ``version`` reads as it was."""
        manifest = self.manifest(version)
        files = [f.path for f in manifest.files if ticker is None or f.ticker == ticker.upper()]
        rows = self._chunks(files)
        return rows.where(F.col("ticker") == ticker.upper()) if ticker else rows

    def _chunks(self, files: list[str], file_col: str | None = None) -> DataFrame:
        if not files:
            empty = self.spark.createDataFrame([], STORED)
            return empty.withColumn(file_col, F.lit("")) if file_col else empty
        reader = self.spark.read.schema(f"{STORED}, part string").option("basePath", f"{self.path}/chunks")
        rows = reader.parquet(*(f"{self.path}/{file}" for file in files))
        return rows.select(*STORED_COLUMNS, *([_below(F.col("_metadata.file_path")).alias(file_col)] if file_col else []))

    def _side(self, table: str, schema: str, parts: list[str]) -> DataFrame:
        """A table that commits add to, of these parts, which all have it: one that was lost is an error and no empty part."""
        paths = [f"{self.path}/{table}/part={p}" for p in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, part string").option("basePath", f"{self.path}/{table}").parquet(*paths)
        return rows.drop("part")

    def _of_files(self, table: str, schema: str, manifest: Manifest) -> DataFrame:
        """What is kept of the live files."""
        live = pa.table({"file": pa.array([f.path for f in manifest.files], pa.string())})
        rows = self._side(table, schema, sorted({f.path.split("/")[1].removeprefix("part=") for f in manifest.files}))
        return rows.join(self.spark.createDataFrame(live), "file", "left_semi")

    def is_indexed(self, ticker: str) -> bool:
        return any(f.ticker == ticker.upper() and f.rows for f in self.manifest().files)

    def count(self) -> int:
        return self.manifest().rows

    def companies(self) -> DataFrame:
        """``companies`` of the whole store; no chunk is read."""
        rows = self._of_files("filings", FILINGS, self.manifest()).where("ticker <> ''")
        return rows.groupBy("ticker").agg(
            F.sum("chunks").alias("chunks"), F.count_distinct(F.nullif("accession_number", F.lit(""))).alias("filings"),
            F.sort_array(F.collect_set(F.nullif("form", F.lit("")))).alias("forms"),
        )

    def stats(self) -> DataFrame:
        """``stats`` of the whole store; no chunk is read."""
        return self._of_files("filings", FILINGS, self.manifest()).agg(
            F.coalesce(F.sum("chunks"), F.lit(0).cast("long")).alias("chunks"), F.sort_array(F.collect_set(F.nullif("ticker", F.lit("")))).alias("tickers"),
            F.sort_array(F.collect_set(F.nullif("form", F.lit("")))).alias("forms"), F.count_distinct(F.nullif("accession_number", F.lit(""))).alias("filings"),
        )

    def table_counts(self) -> DataFrame:
        """``table_counts`` of the whole store, from its manifest."""
        manifest = self.manifest()
        tables = sum(f.tables for f in manifest.files)
        return self.spark.createDataFrame(pa.table({"tables": [tables], "prose": [manifest.rows - tables]}))

    def index(self, scoped: bool = True, version: int | None = None) -> P.StoredIndex:
        """The inverted index of a version."""
        manifest = self.manifest(version)
        parts = [p.name for p in manifest.parts]
        dead = [p.name for p in manifest.parts if p.dead]
        return P.StoredIndex(
            self._side("postings", f"{P.BLOCK}, bucket int", parts), self._side("terms", f"{P.FREQUENCY}, bucket int", parts), self._side("totals", P.TOTALS, parts),
            self._side("dead", P.DEAD, dead) if dead else None, self._chunks([f.path for f in manifest.files]), manifest.buckets, scoped,
        )

    # -- writing ---------------------------------------------------------------------------

    def upsert(self, batch: DataFrame, replace_filings: bool = False) -> int:
        """Add or replace chunks by id and return how many the store holds.

        ``batch`` has the chunk columns and ``seq``, its order; of rows with one id the last is kept, at the place of the
        first. ``replace_filings`` also drops chunks of the batch's filings that it no longer has; filings
        without an accession number cannot be told apart and lose none. Should another writer commit meanwhile, the
        batch is merged anew with what that one left; TRIES times, then Conflict is raised and nothing has changed.
        """
        cleaned = batch.select(*(c if c == "chunk_index" else metadata_value(F.col(c)).alias(c) for c in CHUNK_COLUMNS), "seq")
        rows = last_wins(cleaned).drop("seq")
        staging = f"staging/{uuid.uuid4().hex}"
        try:
            # Ids alone are put in order, over partitions of a bounded size, whatever share of the batch one company has.
            ids = usable(cleaned).groupBy("chunk_id").agg(F.min("seq").alias("_first"))
            ordered = ids.repartitionByRange("_first", "chunk_id").sortWithinPartitions("_first", "chunk_id")
            ordered.select("chunk_id", F.monotonically_increasing_id().alias("_at")).write.parquet(f"{self.path}/{staging}/ids")
            ids = self.spark.read.parquet(f"{self.path}/{staging}/ids")
            if self.embedder:  # asked once, however often the batch is merged
                embed(rows, self.embedder).write.parquet(f"{self.path}/{staging}/rows")
                rows = self.spark.read.parquet(f"{self.path}/{staging}/rows")
            else:
                rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
            for attempt in range(1, TRIES + 1):
                try:
                    return self._merge(ids, rows, replace_filings)
                except Conflict:
                    if attempt == TRIES:
                        raise
        finally:
            self.versions.delete(staging)

    def _merge(self, ids: DataFrame, rows: DataFrame, replace_filings: bool) -> int:
        base = self.manifest()
        manifest = replace(base, version=base.version + 1, buckets=base.buckets if base.version else self.buckets)
        name = f"{manifest.version:08}-{uuid.uuid4().hex}"
        touched = self._touched(ids, rows, base, replace_filings)
        old = self._chunks(sorted(touched))
        held = old.join(ids.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.col("corpus_pos").alias("_old"))
        dead, gone, rest = False, None, old
        if touched:
            out = held.select("_old")
            if replace_filings:
                named = rows.where("accession_number <> ''").select("accession_number").distinct()
                out = out.unionByName(old.join(named, "accession_number", "left_semi").select(F.col("corpus_pos").alias("_old"))).distinct()
            out.select(F.col("_old").alias("corpus_pos"), F.lit(manifest.version).alias("version")).write.parquet(f"{self.path}/dead/part={name}")
            ended = self._side("dead", P.DEAD, [name])
            dead = not ended.isEmpty()
            marked = old.join(marks(ended, base.next_position), F.col("_mark") == place_of_mark(), "left")
            gone, rest = marked.where(is_marked()), marked.where(~is_marked())
        position = numbered(ids, base.next_position).join(held, "chunk_id", "left").select("chunk_id", F.coalesce("_old", "corpus_pos").alias("corpus_pos"))
        # Rows come by their ids already, so positions meet them where they are; terms are made of the texts as they are written and not carried.
        new = rows.join(position, "chunk_id")
        plain = [c for c in STORED_COLUMNS if c != "terms"]
        merged = rest.select(*plain, F.lit(False).alias("_new")).unionByName(new.select(*plain, F.lit(True).alias("_new")))
        # One company to few files, in order of position; the rows of a large one are split over several tasks.
        placed = merged.hint("rebalance", "ticker").sortWithinPartitions("ticker", "corpus_pos").withColumn("terms", T.terms(F.col("text")))
        out = f"{self.path}/chunks/part={name}"
        placed.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").partitionBy("ticker").parquet(out)
        size = ids.count()
        files = self._describe(name)
        added = self.spark.read.schema(f"{STORED}, _new boolean").option("basePath", out).parquet(out).where("_new") if files else None
        if size != (added.count() if files else 0):
            raise RuntimeError("the batch was not the same when it was read again")
        part = Part(name, manifest.version, dead)
        if added is not None:
            self._index(added, gone if dead else None, part, manifest.buckets)
        kept = tuple(f for f in base.files if f.path not in touched)
        manifest = replace(manifest, next_position=base.next_position + size, files=kept + tuple(files), parts=(*base.parts, part) if files else base.parts)
        self.versions.commit(manifest)
        return manifest.rows

    def _touched(self, ids: DataFrame, rows: DataFrame, base: Manifest, replace_filings: bool) -> set[str]:
        """Files that hold an id of the batch, or with ``replace_filings`` a filing of it."""
        files = {f.path for f in base.files}
        if not files:
            return set()
        hashes = if_small(ids.select(F.xxhash64("chunk_id").alias("h")), PROBED_IDS, 8 * PROBED_IDS + 4096)
        if hashes is not None:
            files = self._candidates(base, hashes)
        held = self._chunks(sorted(files), "_file").join(ids.select("chunk_id"), "chunk_id", "left_semi").select("_file").distinct()
        found = {r["_file"] for r in held.collect()}  # names of files
        if replace_filings:
            named = rows.where("accession_number <> ''").select("accession_number").distinct()
            found |= {r["file"] for r in self._of_files("filings", FILINGS, base).join(named, "accession_number", "left_semi").select("file").distinct().collect()}
        return found

    def _candidates(self, base: Manifest, ids: DataFrame) -> set[str]:
        """Files whose filter may hold one of the hashes (PROBED_IDS at most)."""
        sent = self.spark.sparkContext.broadcast(np.array([r["h"] for r in ids.collect()], np.int64).view(np.uint64))

        def probe(batches):
            for batch in batches:
                hit = [may_hold(bits, sent.value) for bits in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], ["file"])

        return {r["file"] for r in self._of_files("filters", FILTERS, base).select("file", "bits").mapInArrow(probe, "file string").collect()}

    def _describe(self, part: str) -> list[File]:
        """Write what is kept of a part's files, and tell the manifest's share of it."""
        if not any(n.startswith("ticker=") for n in self.versions.folders(f"chunks/part={part}")):
            return []
        rows = self.spark.read.schema(STORED).option("basePath", f"{self.path}/chunks/part={part}").parquet(f"{self.path}/chunks/part={part}")
        rows = rows.withColumn("file", _below(F.col("_metadata.file_path")))
        is_table = F.coalesce(F.col("chunk_type") == "table", F.lit(False))
        kept = rows.groupBy("file", "ticker", "form", "accession_number").agg(
            F.count(F.lit(1)).alias("chunks"), F.count_if(is_table).alias("tables"), F.min("corpus_pos").alias("first"), F.max("corpus_pos").alias("last")
        )
        kept.write.parquet(f"{self.path}/filings/part={part}")

        @F.pandas_udf("binary")
        def whole(hashes: pd.Series) -> bytes:
            return id_filter(hashes.to_numpy(np.int64).view(np.uint64))

        # A file's hashes meet in one place: FILE_ROWS at most.
        rows.groupBy("file").agg(whole(F.xxhash64("chunk_id")).alias("bits")).write.parquet(f"{self.path}/filters/part={part}")
        told = self._side("filings", FILINGS, [part]).groupBy("file", "ticker")
        told = told.agg(F.sum("chunks").alias("rows"), F.sum("tables").alias("tables"), F.min("first").alias("first"), F.max("last").alias("last"))
        return [File(r["file"], r["ticker"] or "", r["rows"], r["tables"], r["first"], r["last"]) for r in told.orderBy("file").collect()]

    def _index(self, added: DataFrame, gone: DataFrame | None, part: Part, buckets: int) -> None:
        """The postings of new chunks, and what they and the replaced ones change in the counts."""
        where = lambda table: f"{self.path}/{table}/part={part.name}"
        blocks = P.blocks(added, buckets, part.version)
        blocks.sortWithinPartitions("bucket", "term", "ticker", "window").write.option("compression", "zstd").partitionBy("bucket").parquet(where("postings"))
        posted = self._side("postings", P.BLOCK, [part.name])
        counts, sizes = posted.where("n_text > 0").select("term", "ticker", F.col("n_text").alias("df")), P.lengths(added)
        if gone is not None:
            counts, sizes = counts.unionByName(P.frequencies(gone, -1)), sizes.unionByName(P.lengths(gone, -1))
        counts = counts.groupBy("term", "ticker").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("bucket", P.bucket(F.col("term"), buckets))
        counts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "ticker").write.partitionBy("bucket").parquet(where("terms"))
        sizes.groupBy("ticker").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")).write.parquet(where("totals"))

    def compact(self) -> int:
        """Postings and counts of all commits as one part, without those of replaced chunks; chunks stay as they lie."""
        base = self.manifest()
        if not base.files:
            return 0
        part = Part(f"{base.version + 1:08}-{uuid.uuid4().hex}", base.version + 1)
        self._index(self._chunks([f.path for f in base.files]), None, part, base.buckets)
        self.versions.commit(replace(base, version=base.version + 1, parts=(part,)))
        return base.rows

    def vacuum(self, keep: int = 1) -> int:
        """Delete what no manifest of the latest ``keep`` names, and the earlier manifests. Not beside a writer."""
        numbers = self.versions.numbers()
        kept = [self.manifest(n) for n in numbers[-max(keep, 1) :]]
        files = {f.path.split("/")[1] for m in kept for f in m.files}
        parts = {f"part={p.name}" for m in kept for p in m.parts}
        stale = [f"{t}/{n}" for t in ("chunks", "filings", "filters") for n in self.versions.folders(t) if n not in files]
        stale += [f"{t}/{n}" for t in ("postings", "terms", "totals", "dead") for n in self.versions.folders(t) if n not in parts]
        stale += [f"staging/{n}" for n in self.versions.folders("staging")] + [f"snapshots/{n:08}.json" for n in numbers[: -max(keep, 1)]]
        for below in stale:
            self.versions.delete(below)
        return len(stale)


def _below(file_path: Column) -> Column:
    """A file's path below the store: chunks/part=.../ticker=.../name, as it is written and not as it is told, an encoded URI."""
    return F.concat(F.lit("chunks/part="), F.url_decode(F.replace(F.substring_index(file_path, "/chunks/part=", -1), F.lit("+"), F.lit("%2B"))))


def write_json(path: str, text: str) -> None:
    """A small driver-side JSON file that ends with a line break."""
    Path(path).write_text(text.rstrip("\n") + "\n")
