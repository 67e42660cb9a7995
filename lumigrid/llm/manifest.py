"""A Merkle manifest of a dataset: leaf hashes, a tree for each source, one tree over the sources, and proofs.

Each parent is stored with its preimage, the concatenated hashes of its children. A leaf's proof is made of its
ancestors' preimages: cutting its own 64 characters out of one gives the siblings, and putting another hash there and
hashing again gives the parent that this hash would lead to.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumigrid.session import Scratch, materialize, table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HASH = 64
#: Rows of a small table up to which it is broadcast.
_BROADCAST = 100_000


def sha(value: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8."""
    return F.sha2(F.encode(value, "utf-8"), 256)


def leaf_hash(fields: dict[str, Column]) -> Column:
    """The hash of the fields one after the other: `-` for null, else the UTF-8 length, a colon and the value."""
    texts = [c.cast("string") for c in fields.values()]
    return sha(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def hit(doc_id: Column) -> Column:
    """Whether a document is tampered with: 5 divides the CRC-32 of the decimal doc_id; never for a null one."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, changed): the leaf of each document and, where hit, that with the text's A-Z in lower case."""
    fields = {n: F.col(n) for n in FIELDS}
    lowered = fields | {"text": F.translate("text", ascii_uppercase, ascii_lowercase)}
    hashed = docs.select(*FIELDS, leaf_hash(fields).alias("leaf"))
    return hashed.select("doc_id", "source", "leaf", F.when(hit(F.col("doc_id")), leaf_hash(lowered)).otherwise(F.col("leaf")).alias("changed"))


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(_BROADCAST + 1).count() <= _BROADCAST else df


def placed(rows: DataFrame, tree: str, order: list[str], scratch: Scratch) -> DataFrame:
    """rows with place, from 0 within each value of tree by order; nulls come first and are a tree of their own.

    Rows are dealt by ranges of tree and order, so a large tree lies in many tasks. Numbers within a task and tree are
    added to the counts of the tasks before.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_first(c) for c in (tree, *order)]
    # the number of a task is stored, as ranges may differ if they are drawn again
    dealt = scratch.table(rows.repartitionByRange(width, *by).withColumn("_task", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(tree, "_task").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(tree).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(tree).alias("_tree"), F.col("_task").alias("_of"), F.coalesce(before, F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_task", tree).orderBy(*(F.asc_nulls_first(c) for c in order))) - 1
    ranked = dealt.withColumn("_at", within)
    met = ranked.join(_small(offsets), ranked[tree].eqNullSafe(F.col("_tree")) & (F.col("_task") == F.col("_of")))
    return met.select(*rows.columns, (F.col("_offset") + F.col("_at")).cast("long").alias("place"))


def parents(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """(tree, place, hash, preimage as binary) of the nodes over nodes (tree, place, hash); fan consecutive ones have one parent."""
    up = F.floor(F.col("place") / fan).cast("long")
    grouped = nodes.groupBy("tree", up.alias("place")).agg(F.array_sort(F.collect_list(F.struct((F.col("place") % fan).alias("slot"), "hash"))).alias("own"))
    joined = grouped.select("tree", "place", F.encode(F.array_join(F.transform("own", lambda c: c["hash"]), ""), "utf-8").alias("preimage"))
    return joined.select("tree", "place", F.sha2("preimage", 256).alias("hash"), "preimage")


def levels(nodes: DataFrame, scratch: Scratch, fan: int = FAN) -> list[DataFrame]:
    """The parents of nodes (tree, place, hash), theirs, and so on; a tree ends where it has one node."""
    out, now = [], nodes
    while True:
        # a tree of one node has place 0 only
        many = now.where("place > 0").select("tree").distinct()
        open_trees = now.join(_small(many), now["tree"].eqNullSafe(many["tree"]), "left_semi")
        made = scratch.table(parents(open_trees, fan), f"level-{len(out) + 1}")
        if made.isEmpty():
            return out
        out.append(made)
        now = made.select("tree", "place", "hash")


def roots(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(tree, hash): the one node that is left of each tree."""
    best = nodes.where("place = 0").select("tree", "hash", F.lit(0).alias("level"))
    for k, level in enumerate(above, 1):
        best = best.unionByName(level.where("place = 0").select("tree", "hash", F.lit(k).alias("level")))
    return best.groupBy("tree").agg(F.max_by("hash", "level").alias("hash"))


def _above(nodes: DataFrame, upper: DataFrame, name: str, fan: int) -> DataFrame:
    """nodes with the path of the parent that upper (tree, place, path) has of each, as name."""
    parent = upper.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), F.col("path").alias(name))
    up = F.floor(nodes["place"] / fan).cast("long")
    return nodes.join(parent, nodes["tree"].eqNullSafe(F.col("_t")) & (up == F.col("_p")), "left").drop("_t", "_p")


def with_paths(nodes: DataFrame, above: list[DataFrame], fan: int = FAN) -> DataFrame:
    """nodes (tree, place, more columns) with path, the preimages of all ancestors from the parent up; none for a lone node.

    From the root down each level joins the one above, so a leaf meets one row.
    """
    none = F.array().cast("array<binary>")
    down = None
    for level in reversed(above):
        own = F.array("preimage")
        if down is None:
            down = level.select("tree", "place", own.alias("path"))
        else:
            down = _above(level, down, "_path", fan).select("tree", "place", F.concat(own, F.coalesce("_path", none)).alias("path"))
    if down is None:
        return nodes.withColumn("path", none)
    return _above(nodes, down, "path", fan).withColumn("path", F.coalesce("path", none))


def _around(preimage: Column, place: Column, fan: int) -> tuple[Column, Column]:
    """What stands before and after the 64 characters of the node at place among its parent's children."""
    slot = (place % fan).cast("int")
    return F.substring(preimage, 1, slot * _HASH), F.substring(preimage, (slot + 1) * _HASH + 1, fan * _HASH)


def _climb(first: Column, path: Column, place: Column, step, fan: int) -> Column:
    """step(value so far, preimage, place) at each ancestor, from the parent up."""
    start = F.struct(first.alias("value"), place.cast("long").alias("place"))
    up = lambda acc, preimage: F.struct(step(acc["value"], preimage, acc["place"]).alias("value"), F.floor(acc["place"] / fan).cast("long").alias("place"))
    return F.aggregate(path, start, up, lambda acc: acc["value"])


def siblings(path: Column, place: Column, fan: int = FAN) -> Column:
    """The hashes beside a node and its ancestors as binary text, from the node up: each preimage with its own part excised."""
    return _climb(F.encode(F.lit(""), "utf-8"), path, place, lambda out, preimage, at: F.concat(out, *_around(preimage, at, fan)), fan)


def fold(leaf: Column, path: Column, place: Column, fan: int = FAN) -> Column:
    """The root that a hash leads to: at each ancestor it is spliced into the preimage, and that is hashed."""

    def splice(value: Column, preimage: Column, at: Column) -> Column:
        before, after = _around(preimage, at, fan)
        return F.sha2(F.concat(before, F.encode(value, "utf-8"), after), 256)

    return _climb(leaf, path, place, splice, fan)


def manifest(docs: DataFrame, scratch: Scratch, fan: int = FAN) -> DataFrame:
    """doc_id, source, leaf, subroot, root, place, path, top_place, top_path and changed of each row of docs (FIELDS).

    Leaves ascend by doc_id within their source; rows of one doc_id are ordered by leaf, a null doc_id comes first, rows
    without source are a source of their own, before the others. Repeated rows are leaves of their own. No rows give no
    rows. Further columns are not read. changed is the leaf after tampering; path and top_path prove a leaf, through the
    source's tree and the tree over sources. The levels of both are tables of scratch, to be cleared once the result is
    no longer used.
    """
    # place orders rows of one doc_id by leaf, so it does not depend on partitions
    own = scratch.table(placed(scratch.table(leaves(docs), "leaves"), "source", ["doc_id", "leaf"], scratch), "places")
    nodes = own.select(F.col("source").alias("tree"), "place", F.col("leaf").alias("hash"))
    above = levels(nodes, scratch, fan)
    subroots = scratch.table(roots(nodes, above), "subroots").select(F.lit(0).alias("all"), F.col("tree").alias("source"), F.col("hash").alias("subroot"))
    ranked = scratch.table(placed(subroots, "all", ["source"], scratch), "ranked").withColumnRenamed("all", "tree")
    top_nodes = ranked.select("tree", "place", F.col("subroot").alias("hash"))
    top = levels(top_nodes, scratch, fan)
    root = roots(top_nodes, top).first()
    sources = with_paths(ranked, top, fan).select(F.col("source").alias("_s"), "subroot", F.col("place").alias("top_place"), F.col("path").alias("top_path"))
    proved = with_paths(own.withColumnRenamed("source", "tree"), above, fan)
    met = proved.join(_small(scratch.table(sources, "sources")), F.col("tree").eqNullSafe(F.col("_s")))
    return met.select("doc_id", F.col("tree").alias("source"), "leaf", "subroot", F.lit(root["hash"] if root else None).cast("string").alias("root"), "place", "path", "top_place", "top_path", "changed")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: leaves, roots, the digest of each proof, and what tampering with some texts leads to."""
    scratch = Scratch(spark)
    proved = manifest(table(spark, sf_dir, "documents"), scratch)
    beside = F.concat(siblings(F.col("path"), F.col("place")), siblings(F.col("top_path"), F.col("top_place")))
    folded_root = fold(fold(F.col("changed"), F.col("path"), F.col("place")), F.col("top_path"), F.col("top_place"))
    folded = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded_root.alias("folded_root"))
    out = materialize(folded.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
    scratch.clear()
    return out


#: Levels that the SQL spells out: trees of up to 16 ** 6 leaves, over up to 16 ** 3 sources.
_DEPTH, _TOP = 6, 3


def _levels_sql(name: str, depth: int) -> str:
    """CTEs name1, name2, ... over name0 (tree, place, hash)."""
    return ", ".join(
        f"""{name}{k} as materialized (
  select tree, place // {FAN} as place, sha256(string_agg(hash, '' order by place)) as hash, string_agg(hash, '' order by place) as preimage
  from {name}{k - 1} where tree in (select tree from {name}{k - 1} where place > 0) group by tree, place // {FAN}
)"""
        for k in range(1, depth + 1)
    )


def _subroots_sql(name: str, depth: int) -> str:
    every = " union all ".join(f"select tree, hash, {k} as level from {name}{k} where place = 0" for k in range(depth + 1))
    return f"select tree, max_by(hash, level) as hash from ({every}) group by tree"


def _climb_sql(name: str, source: str, depth: int) -> str:
    """CTEs that take source (tree, place, proof, folded, at, ...) up the levels of name; the last is source_name depth."""
    out = []
    for k in range(1, depth + 1):
        before = source if k == 1 else f"{source}_{name}{k - 1}"
        at = f"cast(b.pos % {FAN} * {_HASH} as bigint)"
        left, right = f"substr(p.preimage, 1, {at})", f"substr(p.preimage, {at} + {_HASH + 1})"
        out.append(f"""{source}_{name}{k} as (
  select b.* replace (b.pos // {FAN} as pos, b.proof || coalesce({left} || {right}, '') as proof, case when p.preimage is null then b.folded else sha256({left} || b.folded || {right}) end as folded)
  from {before} b left join {name}{k} p on b.tree = p.tree and b.pos // {FAN} = p.place
)""")
    return ", ".join(out)


def _leaf_sql(text: str) -> str:
    values = [f"cast({c} as varchar)" for c in FIELDS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_CRC = "list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end), 4294967295)"
ORACLE_SQL = f"""
with leaves as materialized (
  select doc_id, case when source is null then '-' else 's' || source end as tree, {_leaf_sql("text")} as leaf,
    case when xor({_CRC}, 4294967295) % 5 = 0 then {_leaf_sql(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")} else {_leaf_sql("text")} end as changed
  from documents
), own as materialized (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place from leaves
), n0 as (select tree, place, leaf as hash from own),
{_levels_sql("n", _DEPTH)},
subroots as materialized ({_subroots_sql("n", _DEPTH)}),
t0 as materialized (select 0 as tree, row_number() over (order by tree) - 1 as place, hash, tree as source from subroots),
{_levels_sql("t", _TOP)},
low as (select *, place as pos, '' as proof, changed as folded from own),
{_climb_sql("n", "low", _DEPTH)},
high as (
  select l.doc_id, l.leaf, t.hash as subroot, l.proof, l.folded, t.tree, t.place as pos from low_n{_DEPTH} l join t0 t on l.tree = t.source
),
{_climb_sql("t", "high", _TOP)}
select doc_id, leaf, subroot, r.hash as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.hash as verified
from high_t{_TOP}, ({_subroots_sql("t", _TOP)}) r
"""
