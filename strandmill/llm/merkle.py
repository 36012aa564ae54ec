"""A Merkle manifest of a dataset: a tree of fan-out 3 over the documents of each source, and one over the sources' roots.

Leaves are range-partitioned by source and id; a leaf's index is its partition's first index plus its place. Every partition
streams its leaves through a stack of mountains, one open run of siblings for each level: a full run is carried as one node
to the next level, the last run of a level is hashed as short as it is, without padding. A run that begins before the
partition or goes on behind it can't be closed there; its members are the partition's edges, a few for each level. The
edges alone are merged by source. Then each leaf's siblings are looked up among the nodes of its own partition and, from its
edges upwards, among what the merging gave, and its path is folded up to the root.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table, tidy

FANOUT = 3
#: What a row is: head of a group in a partition, inner node, leaf. A group's rows come in this order.
HEAD, NODE, LEAF = 0, 1, 2
NODES = "_part int, _g string, _level int, _index long, _digest binary, _edge boolean, _total long"
MERGED = "_part int, _g string, _level int, _index long, _digest binary, _up boolean, _total long"


def hashed(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def width(total: int, level: int, fanout: int) -> int:
    """Nodes of a level over so many leaves."""
    for _ in range(level):
        total = -(-total // fanout)
    return total


class Mountains:
    """The open runs over a stretch of a group's leaves, which begins at any index. nodes: (level, index, digest) of what
    was made here, edges: the members of runs that can't be closed here, leaves included."""

    def __init__(self, total: int, fanout: int):
        self.fanout, self.widths = fanout, [total]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // fanout))
        self.open: list[tuple[int, list[str]] | None] = [None] * len(self.widths)
        self.nodes: list[tuple[int, int, str]] = []
        self.edges: list[tuple[int, int, str]] = []

    def push(self, level: int, index: int, digest: str) -> None:
        while True:
            if level:
                self.nodes.append((level, index, digest))
            if self.widths[level] == 1:
                return  # the group's root
            if self.open[level] is None:
                self.open[level] = (index, [digest])
            else:
                self.open[level][1].append(digest)
            if index % self.fanout != self.fanout - 1 and index != self.widths[level] - 1:
                return
            first, members = self.open[level]
            if first % self.fanout:
                self.leave(level)
                return
            self.open[level] = None
            level, index, digest = level + 1, first // self.fanout, hashed(members)

    def leave(self, level: int) -> None:
        if self.open[level] is not None:
            first, members = self.open[level]
            self.edges += [(level, first + k, m) for k, m in enumerate(members)]
            self.open[level] = None

    def end(self) -> None:
        """The stretch is over: what is still open are its right edges."""
        for level in range(len(self.open)):
            self.leave(level)


def lists(batch) -> list[list]:
    return [batch.column(i).to_pylist() for i in range(batch.num_columns)]


def built(fanout: int):
    """mapInArrow: node and edge records of each (partition, group) from its head and its leaves in order."""
    import pyarrow as pa

    schema = pa.schema([("_part", pa.int32()), ("_g", pa.string()), ("_level", pa.int32()), ("_index", pa.int64()), ("_digest", pa.binary()), ("_edge", pa.bool_()), ("_total", pa.int64())])

    def run(batches):
        stack, part, group, at = None, None, None, 0
        for batch in batches:
            out: list[tuple] = []

            def emit(until_end):
                if stack is None:
                    return
                if until_end:
                    stack.end()
                out.extend((part, group, level, i, bytes.fromhex(d), edge, stack.widths[0]) for found, edge in ((stack.nodes, False), (stack.edges, True)) for level, i, d in found)
                stack.nodes, stack.edges = [], []

            for p, g, kind, first, total, leaf in zip(*lists(batch)):
                if kind == HEAD:
                    emit(True)
                    stack, part, group, at = Mountains(total, fanout), p, g, first
                else:
                    stack.push(0, at, leaf.hex())
                    at += 1
            emit(False)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, schema.types)], schema=schema)
        if stack is not None:
            stack.end()
            if stack.edges:
                rows = [(part, group, level, i, bytes.fromhex(d), True, stack.widths[0]) for level, i, d in stack.edges]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return tidy(run)


def merged(fanout: int, low: int, high: int):
    """applyInPandas over the edges of one group from level `low` on, those below one node of level `high`: for each
    partition, the runs from its edges up to that node or the root. The node itself, where it isn't the root, goes up
    (_up) for each partition whose edges are below it. What comes together is bounded by the number of partitions, at most
    2 * (fanout - 1) edges for each level of one, whatever the number of rows."""

    def run(edges):
        import pandas as pd

        group, total = edges["_g"].iloc[0], int(edges["_total"].iloc[0])
        top = 0
        while width(total, top, fanout) > 1:
            top += 1
        end = min(high, top)
        known: dict[int, dict[int, bytes]] = {level: {} for level in range(low, end + 1)}
        for level, i, d in zip(edges["_level"], edges["_index"], edges["_digest"]):
            known[level][int(i)] = bytes(d)
        runs: dict[int, dict[int, list[int]]] = {}
        for level in range(low, end):
            here = runs[level] = {}
            for i in sorted(known[level]):
                here.setdefault(i // fanout, []).append(i)
            for parent, members in here.items():
                if len(members) != min(fanout, width(total, level, fanout) - parent * fanout):
                    raise ValueError(f"a run of source {group!r} lacks members at level {level}")
                known[level + 1][parent] = bytes.fromhex(hashed([known[level][i].hex() for i in members]))
        out, seen = [], set()
        for part, level, i in zip(edges["_part"], edges["_level"], edges["_index"]):
            level, i = int(level), int(i) // fanout
            while level < end and (part, level, i) not in seen:
                seen.add((part, level, i))
                out += [(part, group, level, k, known[level][k], False, total) for k in runs[level][i]]
                level, i = level + 1, i // fanout
            if level == end and (part, level) not in seen:
                seen.add((part, level))
                out += [(part, group, level, k, d, end < top, total) for k, d in known[end].items()]
        return pd.DataFrame(out, columns=["_part", "_g", "_level", "_index", "_digest", "_up", "_total"])

    return run


def merged_runs(edges: DataFrame, n_leaves: int, name: str, fanout: int = FANOUT) -> DataFrame:
    """The edges merged in two rounds: first below the nodes that hold some partitions' leaves each, then above these."""
    middle = 1
    while fanout**middle * partitions(edges.sparkSession) < 4 * n_leaves:
        middle += 1
    leaves_of = F.element_at(F.array(*[F.lit(fanout ** (middle - k)) for k in range(middle)]), F.col("_level") + 1)  # of a node at the middle, in nodes of the level
    below = F.call_function("div", F.col("_index"), leaves_of)
    first = edges.where(F.col("_level") < middle).withColumn("_span", below).groupBy("_g", "_span").applyInPandas(merged(fanout, 0, middle), MERGED)
    first = materialize(first, f"{name}-merged")
    above = edges.where(F.col("_level") >= middle).select(*first.columns[:5], F.lit(True).alias("_up"), "_total").unionByName(first.where("_up"))
    second = above.groupBy("_g").applyInPandas(merged(fanout, middle, 64), MERGED)
    return first.where("not _up").unionByName(second)


class Paths:
    """Siblings on the way up from a group's nodes; of each level the last path is kept, as neighbours share it."""

    def __init__(self, total: int, fanout: int, nodes: dict[tuple[int, int], str]):
        self.fanout, self.nodes, self.total = fanout, nodes, total
        self.widths = [total]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // fanout))
        self.last: list[tuple[int, list[tuple[str, str]]]] = [(-1, [])] * len(self.widths)

    def sides(self, level: int, index: int, members: dict[int, str] | None = None) -> tuple[str, str]:
        start = index - index % self.fanout
        get = lambda i: (members or {}).get(i) or self.nodes[level, i]
        return "".join(get(i) for i in range(start, index)), "".join(get(i) for i in range(index + 1, min(start + self.fanout, self.widths[level])))

    def above(self, level: int, index: int) -> list[tuple[str, str]]:
        """(left, right) siblings of a node and of all its ancestors below the root."""
        if self.widths[level] == 1:
            return []
        if self.last[level][0] != index:
            self.last[level] = (index, [self.sides(level, index), *self.above(level + 1, index // self.fanout)])
        return self.last[level][1]

    def root(self, lone: str | None) -> str:
        return lone if len(self.widths) == 1 else self.nodes[len(self.widths) - 1, 0]


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def to_text(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{left}|{right}" for left, right in path)


def from_text(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split("|")) for x in path.split(";")] if path else []


def proven(fanout: int, key_type):
    """mapInArrow over heads, nodes and leaves of each (partition, group), in this order: (_key, _leaf, _top, _root, _path,
    _proof, _folded) of each leaf. Only the leaves of one run are held beside the nodes."""
    import pyarrow as pa

    schema = pa.schema([("_key", key_type), ("_leaf", pa.string()), ("_top", pa.string()), ("_root", pa.string()), ("_path", pa.string()), ("_proof", pa.string()), ("_folded", pa.string())])

    def run(batches):
        paths, run_at, members, upper, root, want_path, at = None, -1, [], [], "", False, 0
        out: list[tuple] = []

        def flush():
            if not members:
                return
            by_index = {i: leaf for i, _, leaf, _ in members}
            lone = members[0][2] if paths.total == 1 else None
            shared = paths.above(1, run_at) if paths.total > 1 else []
            top = paths.root(lone)
            tail = "".join(a + b for a, b in shared) + "".join(a + b for a, b in upper)
            for i, key, leaf, other in members:
                own = [paths.sides(0, i, by_index)] if paths.total > 1 else []
                path = own + shared + upper
                proof = hashlib.sha256(("".join(a + b for a, b in own) + tail).encode()).hexdigest()
                out.append((key, leaf, top, root or top, to_text(own + shared) if want_path else None, proof, fold(other, path)))
            members.clear()

        for batch in batches:
            for _, _, kind, level, index, key, digest, other, total, text, above in zip(*lists(batch)):
                if kind == HEAD:
                    flush()
                    paths, at, run_at = Paths(total, fanout, {}), index, -1
                    upper, root, want_path = from_text(text) if text else [], above or "", text is None
                elif kind == NODE:
                    paths.nodes[level, index] = digest.hex()
                else:
                    if at // fanout != run_at:
                        flush()
                        run_at = at // fanout
                    members.append((at, key, digest.hex(), other.hex()))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, schema.types)], schema=schema)
            out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return tidy(run)


def in_partitions(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The leaves with their range's number, and a head for each (range, group): first index and number of leaves of the group."""
    rows = leaves.repartitionByRange(partitions(leaves.sparkSession), "_g", "_key", "_leaf").withColumn("_part", F.spark_partition_id())
    rows = materialize(rows, f"{name}-leaves")  # written once, as a second look would deal anew
    pairs = rows.groupBy("_part", "_g").agg(F.count("*").alias("_n"))
    by_group = Window.partitionBy("_g")
    before = by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    return rows, materialize(pairs.select("_part", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(by_group).alias("_total")), f"{name}-heads")


def node_records(leaves: DataFrame, heads: DataFrame, name: str, fanout: int = FANOUT) -> DataFrame:
    """The manifest's node records, level 1 upwards, with the partitions' edges (_edge, leaves among them)."""
    head = heads.select("_part", "_g", F.lit(HEAD).alias("_kind"), "_first", "_total", F.lit(None).cast("binary").alias("_leaf"))
    none = F.lit(None).cast("long")
    rows = head.unionByName(leaves.select("_part", "_g", F.lit(LEAF).alias("_kind"), none.alias("_first"), none.alias("_total"), "_leaf", "_key"), allowMissingColumns=True)
    rows = rows.repartitionById(partitions(leaves.sparkSession), F.col("_part")).sortWithinPartitions("_part", "_g", "_kind", "_key", "_leaf").drop("_key")
    return materialize(rows.mapInArrow(built(fanout), NODES), f"{name}-nodes")


def climbed(leaves: DataFrame, heads: DataFrame, nodes: DataFrame, higher: DataFrame, top: DataFrame | None, fanout: int = FANOUT) -> DataFrame:
    """Each leaf with its path and the digest that folding `_other` along it gives. top: (_tg, _tpath, _troot), the groups'
    own paths in the tree above; without it a group's root is the end."""
    from pyspark.sql.pandas.types import to_arrow_type

    none = lambda t: F.lit(None).cast(t)
    key_type = leaves.schema["_key"].dataType
    if top is None:
        head = heads.withColumn("_text", none("string")).withColumn("_above", none("string"))
    else:
        head = heads.join(top, F.col("_g").eqNullSafe(F.col("_tg"))).withColumn("_text", F.col("_tpath")).withColumn("_above", F.col("_troot"))
    head = head.select("_part", "_g", F.lit(HEAD).alias("_kind"), F.lit(0).alias("_level"), F.col("_first").alias("_index"), none(key_type).alias("_key"), none("binary").alias("_leaf"), none("binary").alias("_other"), "_total", "_text", "_above")
    own = nodes.where("_level > 0").select(*[c for c in ("_part", "_g", "_level", "_index", "_digest")]).unionByName(higher)
    inner = own.select("_part", "_g", F.lit(NODE).alias("_kind"), "_level", "_index", F.col("_digest").alias("_leaf"))
    outer = leaves.select("_part", "_g", F.lit(LEAF).alias("_kind"), F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_index"), "_key", "_leaf", "_other")
    rows = head.unionByName(inner, allowMissingColumns=True).unionByName(outer, allowMissingColumns=True)
    rows = rows.repartitionById(partitions(leaves.sparkSession), F.col("_part")).sortWithinPartitions("_part", "_g", "_kind", "_level", "_index", "_key", "_leaf")
    schema = f"_key {key_type.simpleString()}, _leaf string, _top string, _root string, _path string, _proof string, _folded string"
    return rows.mapInArrow(proven(fanout, to_arrow_type(key_type)), schema)


def field(value: Column) -> Column:
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(_g, _key, _leaf, _other): source, doc_id, the row's digest and that of the row as it may have been tampered with."""
    c = lambda text: F.unhex(F.sha2(F.concat(*[field(F.col(x)) for x in ("doc_id", "source", "lang", "n_chars")], field(text)), 256))
    cut = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    tampered = F.when(cut, c(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(c(F.col("text")))
    return docs.select(F.col("source").alias("_g"), F.col("doc_id").alias("_key"), c(F.col("text")).alias("_leaf"), tampered.alias("_other"))


def manifest(leaves: DataFrame, name: str, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(dealt leaves, heads, node records, merged runs, roots by group) of rows _g, _key, _leaf, _other."""
    dealt, heads = in_partitions(leaves, name)
    nodes = node_records(dealt, heads, name, fanout)
    higher = materialize(merged_runs(nodes.where("_edge"), dealt.count(), name, fanout).drop("_up", "_total"), f"{name}-runs")
    n_levels = lambda total: F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.struct(total.alias("w"), F.lit(0).alias("l")), lambda a, _: F.struct(F.floor((a.w + (fanout - 1)) / fanout).alias("w"), (a.l + F.when(a.w > 1, 1).otherwise(0)).alias("l")), lambda a: a.l)
    lone = dealt.join(heads.where("_total = 1").select(F.col("_g").alias("_h"), F.col("_part").alias("_p")), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_part") == F.col("_p"))).select("_g", F.col("_leaf").alias("_digest"))
    local = nodes.where(~F.col("_edge") & (F.col("_level") == n_levels(F.col("_total")))).select("_g", "_digest")
    totals = heads.groupBy(F.col("_g").alias("_h")).agg(F.first("_total").alias("_t"))
    far = higher.join(totals, F.col("_g").eqNullSafe(F.col("_h"))).where(F.col("_level") == n_levels(F.col("_t"))).select("_g", "_digest").distinct()
    return dealt, heads, nodes, higher, lone.unionByName(local).unionByName(far)


def proofs(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    Nulls are marked in the leaves; a null source is a source of its own, the first one; rows with a null doc_id come first
    in their source; rows with equal ids are ordered by their digests, and equal rows are leaves each. Null ids and null
    texts are never tampered with. A lone leaf is its source's root, a lone source's root the root. An empty table gives no
    rows; other columns, whatever their names, are not read. Texts are read once, into digests.
    """
    dealt, heads, nodes, higher, roots = manifest(materialize(leaf_rows(docs), "merkle-digests"), "merkle", fanout)
    sub = materialize(roots.select(F.lit(None).cast("string").alias("_g"), F.col("_g").alias("_key"), F.col("_digest").alias("_leaf"), F.col("_digest").alias("_other")), "merkle-subroots")
    top_dealt, top_heads, top_nodes, top_higher, _ = manifest(sub, "merkle-top", fanout)
    top = climbed(top_dealt, top_heads, top_nodes, top_higher, None, fanout).select(F.col("_key").alias("_tg"), F.col("_path").alias("_tpath"), F.col("_top").alias("_troot"))
    done = climbed(dealt, heads, nodes, higher, materialize(top, "merkle-top-paths"), fanout)
    return done.select(F.col("_key").alias("doc_id"), F.col("_leaf").alias("leaf"), F.col("_top").alias("subroot"), F.col("_root").alias("root"), F.col("_proof").alias("proof_sha256"), F.col("_folded").alias("folded_root"), (F.col("_folded") == F.col("_root")).alias("verified"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    return proofs(table(spark, sf_dir, "documents"))


ORACLE = r"""
with recursive
fields as (
  select doc_id, source, text,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head
  from documents),
bits as (  -- crc32, bit by bit over the decimal id
  select id, 4294967295::bigint as c, 0 as k from (select distinct doc_id::varchar as id from documents where doc_id is not null)
  union all
  select id, case when k % 9 = 0 then xor(c, ascii(id[k // 9 + 1])::bigint)
                  when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end, k + 1
  from bits where k < 9 * length(id)),
even as (select id::bigint as id from bits where k = 9 * length(id) and xor(c, 4294967295::bigint) % 2 = 0),
leaves as (
  select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         case when e.id is not null then sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
              else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as other
  from fields left join even e on doc_id = e.id),
placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, row_number() over () as r from leaves),
tree as (
  select source, 0 as lvl, i, leaf as h, count(*) over (partition by source) as n from placed
  union all
  select source, lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3)
  from tree where n > 1 group by source, lvl, i // 3),
subs as (select source, h, row_number() over (order by source nulls first) - 1 as s from tree where n = 1),
top as (
  select 0 as lvl, s as i, h, count(*) over () as n from subs
  union all
  select lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3) from top where n > 1 group by lvl, i // 3),
nodes as (select source, 0 as high, lvl, i, h, n from tree where n > 1
          union all select null, 1, lvl, i, h, n from top where n > 1),
sib as (
  select p.r, 0 as high, a.lvl, string_agg(a.h, '' order by a.i) filter (a.i < p.i // (3 ** a.lvl)::bigint) as lft,
         string_agg(a.h, '' order by a.i) filter (a.i > p.i // (3 ** a.lvl)::bigint) as rgt
  from placed p join nodes a on a.high = 0 and a.source is not distinct from p.source and a.i // 3 = p.i // (3 ** (a.lvl + 1))::bigint
  group by p.r, a.lvl
  union all
  select p.r, 1, a.lvl, string_agg(a.h, '' order by a.i) filter (a.i < u.s // (3 ** a.lvl)::bigint),
         string_agg(a.h, '' order by a.i) filter (a.i > u.s // (3 ** a.lvl)::bigint)
  from placed p join subs u on u.source is not distinct from p.source join nodes a on a.high = 1 and a.i // 3 = u.s // (3 ** (a.lvl + 1))::bigint
  group by p.r, a.lvl),
steps as (select r, coalesce(lft, '') as lft, coalesce(rgt, '') as rgt, row_number() over (partition by r order by high, lvl) as k from sib),
proof as (select r, sha256(string_agg(lft || rgt, '' order by k)) as proof, max(k) as n from steps group by r),
fold as (
  select r, other as h, 0 as k from placed
  union all
  select f.r, sha256(lft || h || rgt), f.k + 1 from fold f join steps s on s.r = f.r and s.k = f.k + 1),
ends as (select f.r, f.h from fold f left join proof p using (r) where f.k = coalesce(p.n, 0))
select p.doc_id, p.leaf, u.h as subroot, (select h from top where n = 1) as root, coalesce(q.proof, sha256('')) as proof_sha256,
       e.h as folded_root, e.h = (select h from top where n = 1) as verified
from placed p join subs u on u.source is not distinct from p.source left join proof q using (r) join ends e using (r)
"""
