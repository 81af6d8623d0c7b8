"""An inverted index as tables, and queries on it.

Postings (term, doc_id, tf, positions, len) are written by buckets of terms, in order of the term, so a query reads the
buckets of its own terms and in these the parts that hold them; a table of documents (doc_id, path, hash, len) and one
row of statistics stand beside them. Texts are not read by a query, but for the excerpts of the hits that it shows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.search import B, K1, tokens
from lakeloom.sources.connectors import scratch

BUCKETS = 64
#: Tasks among which the postings of a bucket are dealt when they are written.
SPREAD = 8
_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    documents: DataFrame
    stats: DataFrame


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _postings(docs: DataFrame, lowercase: bool) -> tuple[DataFrame, DataFrame]:
    text = F.lower("text") if lowercase else F.col("text")
    t = docs.withColumn("tk", F.coalesce(tokens(text), F.array().cast("array<string>")))
    words = t.select("doc_id", F.size("tk").alias("len"), F.posexplode("tk").alias("pos", "term"))
    postings = words.groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return postings, t.select("doc_id", "path", "hash", F.size("tk").alias("len"))


def _write(spark: SparkSession, postings: DataFrame, documents: DataFrame) -> Index:
    folder = scratch(spark, "text-index")
    p = postings.select("term", "doc_id", "tf", "positions", "len", bucket(F.col("term")).alias("bucket"))
    # a bucket is dealt to a few tasks, so that one frequent word isn't all one task's
    p.repartition("bucket", F.pmod("doc_id", F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(f"{folder}/postings")
    documents.write.parquet(f"{folder}/documents")
    stored = spark.read.schema(documents.schema).parquet(f"{folder}/documents")
    stored.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")).write.parquet(f"{folder}/stats")
    schema = "term string, doc_id long, tf long, positions array<int>, len int, bucket int"
    return Index(spark.read.schema(schema).parquet(f"{folder}/postings"), stored, spark.read.schema("n long, avgdl double").parquet(f"{folder}/stats"))


def build(docs: DataFrame, lowercase: bool = False) -> Index:
    """The index of docs (doc_id, path, hash, text). One shuffle of the words, one of the postings; a table of fewer splits than
    there are cores, so a small one, is dealt to all of them first."""
    docs = docs.select("doc_id", "path", "hash", "text")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
    return _write(docs.sparkSession, *_postings(docs, lowercase))


def delete(index: Index, ids: DataFrame) -> Index:
    """The index without some documents (doc_id)."""
    gone = ids.select("doc_id").distinct()
    keep = lambda df: df.join(gone, "doc_id", "left_anti")
    return _write(index.documents.sparkSession, keep(index.postings).drop("bucket"), keep(index.documents))


def upsert(index: Index, docs: DataFrame, lowercase: bool = False) -> Index:
    """The index with docs in place of those of the same doc_id."""
    postings, documents = _postings(docs.select("doc_id", "path", "hash", "text"), lowercase)
    gone = docs.select("doc_id").distinct()
    keep = lambda df: df.join(gone, "doc_id", "left_anti")
    return _write(docs.sparkSession, keep(index.postings).drop("bucket").unionByName(postings), keep(index.documents).unionByName(documents))


# Query language ------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Leaf:
    """A word or phrase in a field: text (its tokens) or path (as it stands)."""

    where: str
    words: tuple[str, ...]


@dataclass
class Group:
    """Clauses: how each must occur (+ must, - must not, blank should), and what it is."""

    clauses: list[tuple[str, "Leaf | Group"]] = field(default_factory=list)


_LEXEMES = re.compile(r'\s*(?:(?P<op>AND|OR|NOT)(?=[\s(]|$)|(?P<sign>[+\-])(?=\S)|(?P<open>\()|(?P<close>\))|(?:(?P<field>text|path):)?(?:"(?P<phrase>[^"]*)"|(?P<word>[^\s()"]+)))')


def parse(text: str) -> Group:
    """A query: words, "phrases" and (groups), with + (must), - or NOT (must not), AND, OR, and text: or path: before a word or
    phrase. Clauses without an operator between them are alternatives; AND binds closer than OR. Without a field a word is
    looked for in both. ValueError for what can't be read."""
    found, at = [], 0
    while text[at:].strip():
        m = _LEXEMES.match(text, at)
        if not m:
            raise ValueError(f"query can't be read at {text[at:]!r}")
        found.append(m)
        at = m.end()
    at = 0

    def leaf(m: re.Match) -> "Leaf | Group":
        said = m["phrase"] if m["phrase"] is not None else m["word"]
        words = tuple(_TOKEN.findall(said))
        both = [Leaf("text", words)] * (m["field"] != "path" and bool(words)) + [Leaf("path", (said,))] * (m["field"] != "text")
        return both[0] if len(both) == 1 else Group([("", x) for x in both])

    def one() -> tuple[str, "Leaf | Group"]:
        nonlocal at
        sign = ""
        while at < len(found) and (found[at]["sign"] or found[at]["op"] == "NOT"):
            sign = "-" if found[at]["op"] or found[at]["sign"] == "-" else "+"
            at += 1
        if at == len(found) or found[at]["op"] or found[at]["close"]:
            raise ValueError("a word is missing in the query")
        m = found[at]
        at += 1
        if not m["open"]:
            return sign, leaf(m)
        inner = group()
        if at == len(found) or not found[at]["close"]:
            raise ValueError("a parenthesis is open in the query")
        at += 1
        return sign, inner

    def group() -> Group:
        nonlocal at
        out = Group()
        while at < len(found) and not found[at]["close"]:
            clauses = [one()]
            while at < len(found) and found[at]["op"] == "AND":
                at += 1
                clauses.append(one())
            out.clauses.append(clauses[0] if len(clauses) == 1 else ("", Group([(s or "+", x) for s, x in clauses])))
            if at < len(found) and found[at]["op"] == "OR":
                at += 1
        return out

    query = group()
    if at != len(found):
        raise ValueError("a parenthesis is closed that was not open")
    return query


def _leaves(node: "Leaf | Group") -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else [x for _, c in node.clauses for x in _leaves(c)]


def _evaluate(node: "Leaf | Group", score: dict[Leaf, Column]) -> tuple[Column, Column]:
    """(whether a document matches, its score) from its scores for the leaves, null where one is not found."""
    if isinstance(node, Leaf):
        return score[node].isNotNull(), F.coalesce(score[node], F.lit(0.0))
    must, should, never, total = [], [], [], F.lit(0.0)
    for sign, child in node.clauses:
        hit, value = _evaluate(child, score)
        {"+": must, "-": never, "": should}[sign].append(hit)
        if sign != "-":
            total = total + F.when(hit, value).otherwise(0.0)
    both = lambda hits, op: None if not hits else hits[0] if len(hits) == 1 else op(hits[0], both(hits[1:], op))
    hit = both(must, lambda a, b: a & b) if must else both(should, lambda a, b: a | b)
    if hit is None:  # nothing but what must not be
        return F.lit(False), F.lit(0.0)
    for n in never:
        hit = hit & ~n
    return hit, total


def search(index: Index, query: str, lowercase: bool = False) -> DataFrame:
    """doc_id, score of the documents that match, by published BM25. A phrase counts as one word that occurs as often as it
    does, with its words' weights together."""
    tree = parse(query.lower() if lowercase else query)
    leaves = list(dict.fromkeys(_leaves(tree)))
    spark = index.documents.sparkSession
    if not leaves:
        return spark.createDataFrame([], "doc_id long, score double")
    words = sorted({w for x in leaves if x.where == "text" for w in x.words})
    paths = sorted({x.words[0] for x in leaves if x.where == "path"})
    places = [r[0] for r in spark.createDataFrame([(w,) for w in words] or [("",)], "w string").select(bucket(F.col("w"))).distinct().collect()]
    read = index.postings.filter(F.col("bucket").isin(places) & F.col("term").isin(words)).select("term", "doc_id", "tf", "positions", "len")
    counted = read.groupBy().agg(*[F.count_if(F.col("term") == w).alias(f"df{k}") for k, w in enumerate(words)], F.count("*").alias("all"))
    named = index.documents.filter(F.col("path").isin(paths)).select("doc_id", "path")
    many = named.groupBy().agg(*[F.count_if(F.col("path") == p).alias(f"pf{k}") for k, p in enumerate(paths)], F.count("*").alias("named"))
    stats = index.stats.crossJoin(counted).crossJoin(many)
    idf = lambda df: F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))

    inside = [F.max(F.when(F.col("term") == w, F.struct("tf", "positions"))).alias(f"w{k}") for k, w in enumerate(words)]
    by_doc = read.groupBy("doc_id").agg(F.max("len").alias("len"), *inside)
    at = named.groupBy("doc_id").agg(F.max("path").alias("path"))
    rows = by_doc.join(at, "doc_id", "full_outer") if paths else by_doc.withColumn("path", F.lit(None).cast("string"))
    rows = rows.crossJoin(F.broadcast(stats))  # one row

    def tf(x: Leaf) -> Column:
        cols = [F.col(f"w{words.index(w)}") for w in x.words]
        if len(cols) == 1:
            return cols[0]["tf"]
        follows = lambda p: [F.array_contains(c["positions"], p + i) for i, c in enumerate(cols) if i]

        def whole(p: Column) -> Column:
            hit = F.lit(True)
            for f in follows(p):
                hit = hit & f
            return hit

        there = F.lit(True)
        for c in cols:
            there = there & c.isNotNull()
        return F.when(there, F.size(F.filter(cols[0]["positions"], whole)))

    score: dict[Leaf, Column] = {}
    for x in leaves:
        if x.where == "path":
            k = paths.index(x.words[0])
            score[x] = F.when(F.col("path") == x.words[0], idf(F.col(f"pf{k}")))
        else:
            n, weight = tf(x), F.lit(0.0)
            for w in x.words:
                weight = weight + idf(F.col(f"df{words.index(w)}"))
            score[x] = F.when(n > 0, weight * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("len") / F.col("avgdl"))))
    hit, total = _evaluate(tree, score)
    return rows.filter(F.coalesce(hit, F.lit(False))).select("doc_id", F.round(total, 6).alias("score"))


def query_words(query: str) -> list[str]:
    """The words that a query looks for in texts, for excerpts."""
    return list(dict.fromkeys(w for x in _leaves(parse(query)) if x.where == "text" for w in x.words))


def excerpt(text: Column, words: list[str], width: int = 150) -> Column:
    """The stretch of a text, without tags, in which most of the words stand; the first of several."""
    plain = F.regexp_replace(text, "<[^>]*>", "")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(plain)), F.lit(width // 2))
    pattern = r"(?<![\p{L}\p{N}])(?:" + "|".join(rf"\Q{w}\E" for w in words) + r")(?![\p{L}\p{N}])"
    scored = F.transform(starts, lambda s: F.struct(F.regexp_count(F.substr(plain, s, F.lit(width)), F.lit(pattern)).alias("n"), (-s).alias("s")))
    return F.substr(plain, -F.array_max(scored)["s"], F.lit(width))


def hits(index: Index, docs: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """doc_id, path, hash, score, snippet of the best matches. Only their texts are read."""
    top = search(index, query).orderBy(F.desc("score"), "doc_id").limit(limit)
    shown = index.documents.select("doc_id", "path", "hash").join(F.broadcast(top), "doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi")
    words = query_words(query)
    snippet = excerpt(F.col("text"), words) if words else F.substring("text", 1, 150)
    return shown.join(texts, "doc_id").select("doc_id", "path", "hash", "score", snippet.alias("snippet")).orderBy(F.desc("score"), "doc_id")
