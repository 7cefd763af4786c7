"""Merkle dataset manifest: checkpointed levels, proofs by recomputation.

Every document is a leaf, every source a tree of its leaves by document id, and the
sources' subroots are the leaves of one more tree with the dataset's root.  A node is
the digest of up to three consecutive nodes below it.

1. **Leaves.**  One scan of the texts digests each document; only digests go on.
2. **Places.**  Leaves are dealt by range over (source, id), so a source of any size is
   cut into many tasks; a leaf's place is its rank in its range plus the counted leaves
   of its source in earlier ranges.
3. **Checkpoints.**  Only every ``every``-th level is written.  A level comes from the
   stored one below it by aligned subtrees of 3 ** every nodes, one row each; the levels
   between exist only inside that row's expressions.
4. **Proofs.**  From the root down, each aligned subtree meets the path of its own top
   node, recomputes its missing levels from the stored descendants, hands every stored
   node its siblings on those levels and drops them.  A subtree's path travels once for
   its 3 ** every nodes.

Everything is DataFrames and built-in expressions.  Stored tables lie in the shared
checkpoint folder.

Defined cases: a null field counts as ``-``; a null source is a tree of its own, the
first; null ids come first in their source; rows of one id are ordered by their leaf,
equal rows have equal leaves and each a place; a source of one document has its leaf as
subroot and a dataset of one source has that subroot as root; extra columns are not
read; an empty table gives no levels, no root and an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingpath.llm.common import staged

ARITY = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@dataclass
class Forest:
    """Stored levels 0, every, 2 * every, ... of a set of trees: tree, pos, n (leaves of the tree), digest."""

    levels: list[DataFrame]
    every: int

    @property
    def tops(self) -> DataFrame:
        """One row a tree: its subroot."""
        return self.levels[-1]


@dataclass
class Manifest:
    sources: Forest
    dataset: Forest

    @property
    def root(self) -> str | None:
        top = self.dataset.tops.select("digest").first()
        return top and top["digest"]


def _field(value: Column) -> Column:
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of a document: its fields, each as byte count and value."""
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def _places(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with n (rows of the tree) and pos (rank in it), without gathering a tree in one task."""
    dealt = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), f"{name}-dealt")
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("here"))
    tree = F.sum("here").over
    of = Window.partitionBy("tree")
    counts = counts.select("tree", "part", tree(of).alias("n"), F.coalesce(
        tree(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    return staged(dealt.withColumn("rank", rank).join(counts, ["tree", "part"])
                  .withColumn("pos", F.col("before") + F.col("rank") - 1).drop("rank", "before", "part"), f"{name}-0")


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _subtrees(level: DataFrame, first: int, every: int) -> DataFrame:
    """Aligned subtrees over the stored level ``first``: tree, node, n, members and levels a0 to a<every>.

    A level on which the tree has one node is its last: the arrays above repeat it.
    """
    carried = [c for c in level.columns if c not in ("tree", "n")]
    rows = (level.groupBy("tree", F.floor(F.col("pos") / ARITY ** every).cast("long").alias("node"))
            .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", *[c for c in carried if c != "pos"]))).alias("members"))
            .withColumn("a0", F.transform("members", lambda m: m["digest"])))
    for s in range(every):
        rows = rows.withColumn(f"a{s + 1}", F.when(F.col("n") > ARITY ** (first + s), _parents(F.col(f"a{s}"))).otherwise(F.col(f"a{s}")))
    return rows


def _forest(leaves: DataFrame, every: int, name: str) -> Forest:
    levels, widest = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        first = every * (len(levels) - 1)
        above = _subtrees(levels[-1].select("tree", "n", "pos", "digest"), first, every)
        levels.append(staged(above.select("tree", "n", F.col("node").alias("pos"), F.element_at(f"a{every}", 1).alias("digest")),
                             f"{name}-{first + every}"))
        widest = -(-widest // ARITY ** every)
    return Forest(levels, every)


def build(docs: DataFrame, delivered: Column | None = None, every: int = 3) -> Manifest:
    """The manifest of ``docs``; ``delivered``: the text of a copy to be proven, where it is not the row's own."""
    texts = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    given = leaf(*texts, F.col("text") if delivered is None else delivered)
    digests = staged(docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),  # sorts as the source, null first
        leaf(*texts, F.col("text")).alias("digest"), given.alias("given"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    order = [F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row")]
    sources = _forest(_places(digests, order, "merkle-source").drop("row"), every, "merkle-source")
    subroots = sources.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    dataset = _forest(_places(subroots, [F.col("name")], "merkle-dataset"), every, "merkle-dataset")
    return Manifest(sources, dataset)


def _step(nodes: Column, at: Column) -> Column:
    """The siblings of node ``at`` in its run: those to its left and those to its right, joined."""
    return F.struct(F.array_join(F.slice(nodes, at - at % ARITY + 1, at % ARITY), "").alias("left"),
                    F.array_join(F.slice(nodes, at + 2, ARITY - 1 - at % ARITY), "").alias("right"))


def _descend(forest: Forest, tops: DataFrame) -> DataFrame:
    """Leaves with their paths, from ``tops`` (tree, path and what else a tree hands to its leaves).

    A path is the list of steps from the node up to the root.
    """
    handed = [c for c in tops.columns if c not in ("tree", "path")]
    known = forest.tops.join(tops, "tree")
    for j in reversed(range(len(forest.levels) - 1)):
        first = forest.every * j
        rows = (_subtrees(forest.levels[j], first, forest.every)
                .join(known.select("tree", F.col("pos").alias("node"), "path", *handed), ["tree", "node"])
                .select("*", F.posexplode("members").alias("at", "member")))
        steps = [F.when(F.col("n") > ARITY ** (first + s), F.array(_step(F.col(f"a{s}"), F.floor(F.col("at") / ARITY ** s).cast("int"))))
                 .otherwise(F.array().cast("array<struct<left:string,right:string>>")) for s in range(forest.every)]
        known = rows.select("tree", "n", "member.*", F.concat(*steps, F.col("path")).alias("path"), *handed)
    return known


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, digest, given, path, subroot and root of every document."""
    end = F.array().cast("array<struct<left:string,right:string>>")
    top = manifest.dataset.tops.select("tree", F.col("digest").alias("root"), end.alias("path"))
    sources = _descend(manifest.dataset, top).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return _descend(manifest.sources, sources).select("doc_id", "digest", "given", "path", "subroot", "root")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a proof, from the leaf's level to the root, joined."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def altered(doc_id: Column, text: Column) -> Column:
    """The copy that the query proves: documents of an even checksum lose their line ends."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def verify(docs: DataFrame, delivered: Column | None = None, every: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, one row per document row."""
    rows = proofs(build(docs, delivered, every)).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        fold(F.col("given"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 in plain SQL, for ids as decimal text.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))))"""
_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS[:-1])

ORACLE = f"""
WITH RECURSIVE leaves AS (
    SELECT row_number() OVER () AS nr, doc_id, coalesce('=' || source, '') AS tree,
        sha256({_FIELDS} || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
        CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS copy,
        {_FIELDS} AS front
    FROM documents),
placed AS (
    SELECT *, sha256(front || coalesce(strlen(copy)::VARCHAR || ':' || copy, '-')) AS given,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY tree) AS n
    FROM leaves),
nodes AS (
    SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
    FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
tops AS (
    SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
roots AS (
    SELECT 0 AS lvl, pos, n, h FROM tops
    UNION ALL
    SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
    FROM roots WHERE n > 1 GROUP BY lvl, pos // 3, n),
steps AS (
    SELECT p.nr, 0 AS part, l.lvl, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < p.pos // pow(3, l.lvl)::BIGINT), '') AS a,
        coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > p.pos // pow(3, l.lvl)::BIGINT), '') AS b
    FROM placed p JOIN (SELECT DISTINCT tree, lvl FROM nodes WHERE n > 1) l ON p.tree = l.tree
    JOIN nodes s ON s.tree = p.tree AND s.lvl = l.lvl AND s.pos // 3 = p.pos // pow(3, l.lvl + 1)::BIGINT
    GROUP BY p.nr, l.lvl
    UNION ALL
    SELECT p.nr, 1, l.lvl, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < t.pos // pow(3, l.lvl)::BIGINT), ''),
        coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > t.pos // pow(3, l.lvl)::BIGINT), '')
    FROM placed p JOIN tops t ON p.tree = t.tree JOIN (SELECT DISTINCT lvl FROM roots WHERE n > 1) l ON true
    JOIN roots s ON s.lvl = l.lvl AND s.pos // 3 = t.pos // pow(3, l.lvl + 1)::BIGINT
    GROUP BY p.nr, l.lvl),
numbered AS (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY part, lvl) AS k FROM steps),
proven AS (SELECT nr, string_agg(a || b, '' ORDER BY k) AS proof, max(k) AS last FROM numbered GROUP BY nr),
folded AS (
    SELECT nr, 0::BIGINT AS k, given AS h FROM placed
    UNION ALL
    SELECT f.nr, s.k, sha256(s.a || f.h || s.b) FROM folded f JOIN numbered s ON s.nr = f.nr AND s.k = f.k + 1)
SELECT p.doc_id, p.leaf, t.h AS subroot, r.h AS root, sha256(coalesce(v.proof, '')) AS proof_sha256, f.h AS folded_root,
    f.h = r.h AS verified
FROM placed p JOIN tops t ON p.tree = t.tree JOIN (SELECT h FROM roots WHERE n = 1) r ON true
LEFT JOIN proven v ON v.nr = p.nr JOIN folded f ON f.nr = p.nr AND f.k = coalesce(v.last, 0)
"""
