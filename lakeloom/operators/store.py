"""A content-addressed, versioned store as tables.

chunks (hash, data), blobs (blob_hash, size, chunks: array of hash and length), files (file_hash, blob_hash), directory
entries (dir_hash, name, object_hash, kind), commits (hash, tree_hash, parents, ...), branches (name, head). A hash is the
SHA-256 of what it names, so equal contents, files and whole directories are one object. Walks go level by level: each
level is one join with the frontier and is written once, and what was visited is not visited again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.connectors import scratch

#: Bytes of a chunk, unless a caller says otherwise.
CHUNK_SIZE = 4 << 20
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared scratch folder and read back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Contents ------------------------------------------------------------------------------------------------------------
def starts(data: Column, size: int = CHUNK_SIZE) -> Column:
    """Byte offsets of the windows of a content; an empty one has none."""
    n = F.octet_length(data)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))


def chunk_rows(contents: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """contents (path, data) as path, pos, hash, length, data of each window."""
    cut = contents.select("path", "data", F.posexplode(starts(F.col("data"), size)).alias("pos", "start"))
    cut = cut.select("path", "pos", F.substr("data", F.col("start") + 1, F.lit(size)).alias("data"))
    return cut.select("path", "pos", F.sha2("data", 256).alias("hash"), F.octet_length("data").alias("length"), "data")


def seal(*parts: Column) -> Column:
    """Content id of a manifest: of its fields in a fixed order, the seal itself left out."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def manifests(contents: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """contents with chunks (array of hash and length), size, blob_hash and file_hash added; nothing is shuffled."""
    n = F.octet_length("data")
    chunk = lambda s: F.struct(F.sha2(F.substr("data", s + 1, F.lit(size)), 256).alias("hash"), F.least(F.lit(size), n - s).alias("length"))
    out = contents.withColumns({"chunks": F.transform(starts(F.col("data"), size), chunk), "size": n.cast("long")})
    return with_seals(out)


def blob_seal(chunks: Column) -> Column:
    return F.sha2(F.array_join(F.transform(chunks, lambda c: F.concat(c["hash"], F.lit(":"), c["length"].cast("string"))), ","), 256)


def with_seals(df: DataFrame) -> DataFrame:
    return df.withColumn("blob_hash", blob_seal(F.col("chunks"))).withColumn("file_hash", seal(F.lit("file"), F.col("blob_hash")))


def read_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """files (path, chunks) with data put together from the chunk table (hash, data), and n_bad: chunks that are missing, or
    whose bytes are not those that their hash or length says. An empty file has no chunk and is there too."""
    parts = files.select("path", F.posexplode_outer("chunks").alias("pos", "c")).select("path", "pos", F.col("c.hash").alias("hash"), F.col("c.length").alias("length"))
    found = parts.join(chunks.select("hash", "data"), "hash", "left")
    bad = F.col("pos").isNotNull() & ~F.coalesce((F.sha2("data", 256) == F.col("hash")) & (F.octet_length("data") == F.col("length")), F.lit(False))
    g = found.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("pos", "data")))).alias("parts"), F.count_if(bad).alias("n_bad"))
    return g.select("path", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")).alias("data"), "n_bad")


def byte_range(data: Column, offset: Column, length: Column) -> Column:
    """Bytes from an offset on, which is at most the end; all up to the end for a negative length."""
    at = F.least(F.greatest(offset, F.lit(0)), F.octet_length(data))
    return F.substr(data, at + 1, F.when(length < 0, F.octet_length(data)).otherwise(length))


def damaged(chunks: DataFrame) -> DataFrame:
    """Chunks whose bytes are not those that their hash names."""
    return chunks.filter(F.sha2("data", 256) != F.col("hash"))


def shard(hash_: Column) -> Column:
    """The folder of a chunk, by the first two bytes of its hash."""
    return F.concat_ws("/", F.substring(hash_, 1, 2), F.substring(hash_, 3, 2))


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """Put chunks (hash, data) into a folder of shards: those of one shard stand together, and lookups by hash read one."""
    once = chunks.dropDuplicates(["hash"]).withColumn("shard", F.substring("hash", 1, 2))
    once.repartition("shard").sortWithinPartitions("hash").write.partitionBy("shard").mode("append").parquet(folder)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """hash, data, shard of all chunks in a folder of shards; files that can't be read are passed over."""
    return spark.read.schema("hash string, data binary, shard string").option("ignoreCorruptFiles", "true").parquet(folder)


def get_chunks(spark: SparkSession, folder: str, hashes: list[str]) -> DataFrame:
    """hash, there, size, data of the asked chunks. Only their shards are read, and in these only the parts that may hold
    them."""
    wanted = spark.createDataFrame([(h,) for h in hashes], "hash string")
    found = read_chunks(spark, folder).filter(F.col("shard").isin(sorted({h[:2] for h in hashes})) & F.col("hash").isin(hashes))
    j = F.broadcast(wanted).join(found.select("hash", "data"), "hash", "left")
    return j.select("hash", F.col("data").isNotNull().alias("there"), F.octet_length("data").alias("size"), "data")


# Directories ---------------------------------------------------------------------------------------------------------
def merkle(files: DataFrame) -> DataFrame:
    """Directories of trees, from the deepest up. files: tree, path, object_hash, kind (dir for an empty directory).

    Returns tree, path (of the directory), dir_hash, name, object_hash, kind: a row for each entry. A directory's hash is
    that of its entries in order of their names, so a change reaches the root and equal subtrees are one object."""
    rows = files.select("tree", "path", "object_hash", "kind", (F.size(F.split("path", "/")) - 1).alias("depth"))
    deepest = rows.agg(F.max("depth")).first()[0] or 1
    built, out = None, None
    for depth in range(deepest, 0, -1):
        level = rows.filter(F.col("depth") == depth).drop("depth")
        if built is not None:
            level = level.unionByName(built)
        level = level.select("tree", F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.struct(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "kind", "object_hash").alias("e"))
        listed = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["name"], e["kind"], e["object_hash"])), ",")
        dirs = level.groupBy("tree", "path").agg(F.array_sort(F.collect_list("e")).alias("entries")).withColumn("dir_hash", F.sha2(listed, 256))
        dirs = written(dirs, f"directories-{depth}")
        built = dirs.select("tree", "path", F.col("dir_hash").alias("object_hash"), F.lit("dir").alias("kind"))
        entries = dirs.select("tree", F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path"), "dir_hash", F.inline("entries"))
        out = entries if out is None else out.unionByName(entries)
    return out.select("tree", "path", "dir_hash", "name", "object_hash", "kind")


def roots(entries: DataFrame) -> DataFrame:
    """tree, dir_hash of each tree's root."""
    return entries.filter("path = '/'").select("tree", "dir_hash").distinct()


def listing(entries: DataFrame, root: DataFrame) -> DataFrame:
    """path, kind, hash of all below a root (one column: hash; a row or several), by a walk over the entries."""
    e = entries.select("dir_hash", "name", "object_hash", "kind").distinct()
    frontier, out = root.select(F.lit("").alias("at"), F.col("hash").alias("dir_hash")), None
    while True:
        step = e.join(frontier, "dir_hash").select(F.concat_ws("/", "at", "name").alias("path"), "kind", F.col("object_hash").alias("hash"))
        step = written(step, "listing")
        out = step if out is None else out.unionByName(step)
        frontier = step.filter("kind = 'dir'").select(F.col("path").alias("at"), F.col("hash").alias("dir_hash"))
        if frontier.isEmpty():
            return out


def resolve(entries: DataFrame, root: DataFrame, path: str) -> DataFrame:
    """kind, hash of a path, segment by segment from the root; no row if it isn't there."""
    at = root.select(F.lit("dir").alias("kind"), "hash")
    for name in [x for x in path.split("/") if x]:
        at = at.filter("kind = 'dir'").join(entries.filter(F.col("name") == name).select("dir_hash", "object_hash", F.col("kind").alias("k")).distinct(), F.col("hash") == F.col("dir_hash")).select(F.col("k").alias("kind"), F.col("object_hash").alias("hash"))
    return at


def walk(entries: DataFrame, root: DataFrame) -> DataFrame:
    """hash, kind of every directory and file below the roots (hash), each once, the roots included. Subtrees that several
    share are walked once."""
    e = entries.select("dir_hash", "object_hash", "kind").distinct()
    frontier = written(root.select("hash", F.lit("dir").alias("kind")).distinct(), "walk")
    seen = frontier
    while True:
        step = e.join(frontier.select(F.col("hash").alias("dir_hash")), "dir_hash", "left_semi").select(F.col("object_hash").alias("hash"), "kind").distinct()
        step = written(step.join(seen.select("hash"), "hash", "left_anti"), "walk")
        seen = seen.unionByName(step)
        frontier = step.filter("kind = 'dir'")
        if frontier.isEmpty():
            return seen


def diff_trees(entries: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """op (add, del, mod), path of the files that differ between the trees of two roots (hash, a row each), sorted by path.

    Level by level: directories of equal hash are passed over, a name that is a file here and a directory there is one
    change and isn't gone into, and a directory that only one side has is listed whole."""
    e = entries.select("dir_hash", "name", "object_hash", "kind").distinct()
    frontier = a.select(F.lit("").alias("at"), F.col("hash").alias("a")).crossJoin(b.select(F.col("hash").alias("b")))
    frontier, out = frontier.filter(~F.col("a").eqNullSafe(F.col("b"))), None
    while True:
        side = lambda s: frontier.join(e, F.col(s) == F.col("dir_hash")).select("at", "name", F.col("object_hash").alias(s), F.col("kind").alias(f"{s}k"))  # noqa: B023, E731
        both = side("a").join(side("b"), ["at", "name"], "full_outer").filter(~(F.col("a").eqNullSafe(F.col("b")) & F.col("ak").eqNullSafe(F.col("bk"))))
        both = written(both.withColumn("path", F.concat_ws("/", "at", "name")), "tree-diff")
        only = F.coalesce("ak", "bk")
        down = F.when(F.col("ak").isNotNull() & F.col("bk").isNotNull(), (F.col("ak") == "dir") & (F.col("bk") == "dir")).otherwise(only == "dir")
        op = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "del").otherwise("mod")
        found = both.filter(~down).select(op.alias("op"), "path")
        out = found if out is None else out.unionByName(found)
        frontier = both.filter(down).select(F.col("path").alias("at"), "a", "b")
        if frontier.isEmpty():
            return out.orderBy("path")


# Commits -------------------------------------------------------------------------------------------------------------
def first_parent_log(commits: DataFrame, heads: DataFrame, limit: int) -> DataFrame:
    """branch, depth and the commits' columns: from each head (branch, hash) back along first parents, `limit` commits at
    most. The limit ends a circle too."""
    at, out = heads.select("branch", "hash"), None
    for depth in range(limit):
        step = at.join(commits, "hash").withColumn("depth", F.lit(depth).cast("long"))
        out = step if out is None else out.unionByName(step)
        at = step.filter(F.size("parents") > 0).select("branch", F.get("parents", F.lit(0)).alias("hash"))
    return commits.limit(0).withColumns({"branch": F.lit(""), "depth": F.lit(0).cast("long")}) if out is None else out


def reachable(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """hash of every commit that heads (hash) reach over all parents, each once; unknown ones are not among them."""
    links = written(commits.select("hash", "parents"), "commit-links")
    frontier = written(links.join(heads.select("hash").distinct(), "hash", "left_semi"), "commit-walk")
    seen = frontier.select("hash")
    while not frontier.isEmpty():
        step = frontier.select(F.explode("parents").alias("hash")).distinct().join(seen, "hash", "left_anti")
        frontier = written(links.join(step, "hash", "left_semi"), "commit-walk")
        seen = seen.unionByName(frontier.select("hash"))
    return seen


# Reachability of contents --------------------------------------------------------------------------------------------
def live_objects(commits: DataFrame, heads: DataFrame, entries: DataFrame) -> DataFrame:
    """hash, kind (commit, dir, file) of all manifests that heads reach."""
    live = reachable(commits, heads)
    trees = commits.join(live, "hash", "left_semi").select(F.col("tree_hash").alias("hash")).distinct()
    return live.withColumn("kind", F.lit("commit")).unionByName(walk(entries, trees))


def live_chunks(objects: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """hash, refs of the chunks of live files; each file manifest counts once, repeats within its blob count."""
    live = files.select("file_hash", "blob_hash").distinct().join(objects.filter("kind = 'file'").select(F.col("hash").alias("file_hash")), "file_hash", "left_semi")
    chunks = live.join(blobs.select("blob_hash", "chunks").dropDuplicates(["blob_hash"]), "blob_hash").select(F.explode("chunks.hash").alias("hash"))
    return chunks.groupBy("hash").agg(F.count("*").alias("refs"))


def sweep(chunks: DataFrame, live: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, hashes that are swept) of a chunk table (hash, ...); with dry_run all stay."""
    swept = chunks.select("hash").distinct().join(live.select("hash"), "hash", "left_anti")
    return (chunks if dry_run else chunks.join(live.select("hash"), "hash", "left_semi")), swept


# Snapshots -----------------------------------------------------------------------------------------------------------
def parent(path: Column) -> Column:
    p = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(p == "", "/").otherwise(p)


def name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def join_path(folder: Column, leaf: Column) -> Column:
    return F.when(folder == "/", F.concat(F.lit("/"), leaf)).otherwise(F.concat_ws("/", folder, leaf))


def directories(files: DataFrame) -> DataFrame:
    """path of every directory above files (path), the root included."""
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    dirs = files.select(F.explode(up).alias("path")).distinct()
    return dirs.select(F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("path")).distinct()


def put(files: DataFrame, new: DataFrame) -> DataFrame:
    """A snapshot (path, ...) with new files written over those of the same path."""
    return files.join(new.select("path"), "path", "left_anti").unionByName(new)


def append(files: DataFrame, more: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """A snapshot (path, data, ...) in which more (path, data) stands at the end of its files; a file that isn't there
    begins empty. Manifests are made anew."""
    j = files.select("path", "data").join(more.select("path", F.col("data").alias("tail")), "path", "full_outer")
    return manifests(j.select("path", F.concat(F.coalesce("data", F.unhex(F.lit(""))), F.coalesce("tail", F.unhex(F.lit("")))).alias("data")), size)


def delete_results(files: DataFrame, empty_dirs: DataFrame, paths: DataFrame) -> DataFrame:
    """path, result of deleting each path: ok for a file or an empty directory, root, not empty, or missing."""
    dirs = directories(files).withColumn("dir", F.lit(True))
    j = paths.join(files.select("path", F.lit(True).alias("file")), "path", "left").join(dirs, "path", "left").join(empty_dirs.select("path", F.lit(True).alias("empty")), "path", "left")
    result = F.when(F.col("path") == "/", "root").when(F.col("file") | F.col("empty"), "ok").when(F.col("dir"), "not empty").otherwise("missing")
    return j.select("path", result.alias("result"))


def mkdir_results(files: DataFrame, empty_dirs: DataFrame, paths: DataFrame) -> DataFrame:
    """path, result of making each directory: ok where it is there already too, or exists where a file, or one above it, has
    the path; and new, whether a directory is made."""
    dirs = directories(files).unionByName(empty_dirs.select("path")).distinct().withColumn("dir", F.lit(True))
    f = files.select(F.col("path").alias("up"), F.lit(True).alias("file"))
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(F.split("path", "/")))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("up"))
    blocked = above.join(f, "up", "left").groupBy("path").agg(F.bool_or(F.col("file").isNotNull()).alias("blocked"))
    j = blocked.join(dirs, "path", "left")
    return j.select("path", F.when(F.col("blocked"), "exists").otherwise("ok").alias("result"), (~F.col("blocked") & F.col("dir").isNull() & (F.col("path") != "/")).alias("new"))


def apply_batch(table: DataFrame, operations: DataFrame) -> DataFrame:
    """A key-value table (key, value) after a batch of puts and deletes (ord, op, key, value), of which the last on a key
    counts. All or nothing: an operation of another kind fails the whole batch."""
    if operations.filter(~F.col("op").isin("put", "delete")).count():
        raise ValueError("unknown operation in a batch")
    last = operations.groupBy("key").agg(F.max_by(F.struct("op", "value"), "ord").alias("o"))
    kept = table.join(last.select("key"), "key", "left_anti")
    return kept.unionByName(last.filter("o.op = 'put'").select("key", F.col("o.value").alias("value")))


# Bundles -------------------------------------------------------------------------------------------------------------
def export_bundle(chunks: DataFrame, folder: str, commit: str, compress: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Write a bundle: all chunks (hash, data), or those not known yet, as Parquet with zstd, and one manifest row in JSON beside
    them. Returns the manifest: commit, chunk_count, byte_count, compressed_bytes, seal."""
    spark = chunks.sparkSession
    once = chunks.select("hash", "data").dropDuplicates(["hash"])
    if known is not None:
        once = once.join(known.select("hash"), "hash", "left_anti")
    once.write.option("compression", "zstd" if compress else "uncompressed").parquet(f"{folder}/chunks")
    stored = spark.read.parquet(f"{folder}/chunks")
    on_disk = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/chunks").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("compressed_bytes"))
    digest = F.sha2(F.coalesce(F.sum(F.conv(F.substring("hash", 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string"), 256)
    about = stored.agg(F.lit(commit).alias("commit"), F.count("*").alias("chunk_count"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("byte_count"), digest.alias("seal"))
    about.crossJoin(on_disk).write.json(f"{folder}/manifest")
    return spark.read.schema("commit string, chunk_count long, byte_count long, seal string, compressed_bytes long").json(f"{folder}/manifest")


def verify_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """chunks, failures (wrong hashes), sealed (whether the manifest's seal and counts are those of what is stored)."""
    stored = spark.read.schema("hash string, data binary").parquet(f"{folder}/chunks")
    manifest = spark.read.schema("chunk_count long, byte_count long, seal string").json(f"{folder}/manifest")
    digest = F.sha2(F.coalesce(F.sum(F.conv(F.substring("hash", 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string"), 256)
    now = stored.agg(F.count("*").alias("chunks"), F.count_if(F.sha2("data", 256) != F.col("hash")).alias("failures"), digest.alias("now"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"))
    j = now.crossJoin(manifest)
    return j.select("chunks", "failures", ((F.col("now") == F.col("seal")) & (F.col("chunks") == F.col("chunk_count")) & (F.col("bytes") == F.col("byte_count"))).alias("sealed"))


def compression_ratio(written_: Column, compressed: Column) -> Column:
    return F.when(compressed == 0, 1.0).otherwise(written_ / compressed)


def throughput_mbs(written_: Column, ms: Column) -> Column:
    return F.when(ms == 0, 0.0).otherwise(written_ / (1 << 20) / (ms / 1000))
