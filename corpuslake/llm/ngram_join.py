"""N-gram Jaccard join by vertical partitioning.

Every text is a set of word shingles, each a 64-bit number. The order of these
numbers is the global n-gram order; it is cut into fragments of equal range,
and every set is cut with it. A fragment's task counts the partial overlap of
each pair that shares a shingle there; summed over fragments, the counts are
whole overlaps. Equal sets are one node from the start (a node is the digest of
its set), so copies cost nothing. There are as many fragments as the texts' bytes
ask for, so a fragment's task stays as large as it is while the input grows.

Shingles of more than ``COMMON`` different sets would pair everything with
everything. They are found where they are counted (a map task drops its own
common ones before the shuffle and only sends their numbers), and pairs are not
made from them. What that leaves out is made good exactly:

* a pair that shares a rarer shingle has its overlap of rarer ones, and the
  common ones can add at most the smaller of both sets' common counts; where
  that leaves the answer open, the two sets are intersected;
* a pair that shares common shingles only must, to link, consist of at least
  three quarters common shingles on both sides. These sets (members of large
  groups of near copies) are joined by prefix shingles: rounds of comparing all
  members with one leader per shingle first merge each group into one
  component; what is left over is compared, in cells of bounded size, with all
  sets that it can meet, so that no link between components is lost. A cell
  gives one link for each two components that it joins, never all pairs.

The result is one row per document with its component. A link may be implied
(two members that the same leader links) rather than listed.

Null or empty texts, or those without words, have an empty set and link with
nothing. A null doc_id gets no component of its own but can join others; a
component is named by its smallest doc_id. Repeated rows come back as often as
they are there. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import cut, discard
from .textarrays import blocks, release, rows_of, runs, settled, tidy, words

WIDTH = 5
#: A link: LINK_NUM / LINK_DEN or more of the union is shared.
LINK_NUM, LINK_DEN = 3, 4
#: A shingle of more different sets than this makes no pairs.
COMMON = 16
#: Shingles that a map task holds before it sends them.
HELD = 1_200_000
#: Pairs that a fragment's task makes at once.
PAIRS_AT_ONCE = 1_000_000
#: Bytes of text for each fragment (their shingles are some three times as many bytes).
FRAGMENT_BYTES = 10_000_000
#: Leader rounds go on while pairs across components number more than this times the postings.
PAIRS_PER_POSTING = 8
#: Edges that one task may finish while groups are being searched; the result's components never come that way.
FEW = 200_000
#: Sets on each side of a cell, in which sets of large groups are compared.
CELL = 512
_KEY = 16
_MIXED = "kind int, a binary, b binary, na long, nb long, v long"


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    values, bounds = runs(*words([(t or "").encode() for t in texts]), width)
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def node_key(tokens: np.ndarray) -> bytes:
    """Names a set: 12 bytes of a digest, then its size."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=_KEY - 4).digest() + len(tokens).to_bytes(4, "big")


def links(overlap, na, nb):
    """Whether sets of these sizes and overlap link: overlap / union >= 3 / 4."""
    return LINK_DEN * overlap >= LINK_NUM * (na + nb - overlap)


def _send(held: list[tuple[bytes, np.ndarray]], docs: list[tuple], fragments: int, common: int, turn: int) -> pa.RecordBatch:
    """One row per fragment with the shingles of the held sets there, packed."""
    keys = np.frombuffer(b"".join(k for k, _ in held), np.uint8).reshape(-1, _KEY)
    sizes = np.array([len(t) for _, t in held], np.int64)
    tokens = np.concatenate([t for _, t in held]) if held else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(held)), sizes)
    part = ((tokens >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
    ordered = np.sort(tokens)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(ordered)))
    hot = ordered[first[counts > common]]
    is_hot = np.isin(tokens, hot) if len(hot) else np.zeros(len(tokens), bool)
    cell = part * max(1, len(held)) + owner
    cells, n = np.unique(cell, return_counts=True)
    order = np.argsort(cell, kind="stable")
    hot_before = np.concatenate(([0], np.cumsum(is_hot[order])))
    ends = np.cumsum(n)
    dropped = hot_before[ends] - hot_before[ends - n]
    kept = order[~is_hot[order]]
    sent, sent_part = tokens[kept], part[kept]
    hot_part = ((hot >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
    cell_part = cells // max(1, len(held))
    rows: dict[str, list] = {name: [] for name in ("part", "keys", "counts", "dropped", "tokens", "hot", "docs", "tags", "doc_keys")}
    full = np.unique(np.append(cell_part, [turn % fragments] if docs else []).astype(np.int64))
    (c, c_end), (t, t_end), (h, h_end) = (
        (np.searchsorted(x, full, "left"), np.searchsorted(x, full, "right")) for x in (cell_part, sent_part, hot_part)
    )
    for i, f in enumerate(full.tolist()):
        mine = turn % fragments == f
        own = slice(c[i], c_end[i])
        who = cells[own] % max(1, len(held))
        rows["part"].append(f)
        rows["keys"].append(keys[who].tobytes() if len(who) else b"")
        rows["counts"].append((n - dropped)[own].astype("<u4").tobytes())
        rows["dropped"].append(dropped[own].astype("<u4").tobytes() if dropped[own].any() else b"")
        rows["tokens"].append(sent[t[i] : t_end[i]].tobytes())
        rows["hot"].append(hot[h[i] : h_end[i]].tobytes())
        for i, name in enumerate(("docs", "tags", "doc_keys")):
            rows[name].append([d[i] for d in docs] if mine else [])
    types = [pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(rows.values(), types)], names=list(rows))


_SENT = "part int, keys binary, counts binary, dropped binary, tokens binary, hot binary, docs array<bigint>, tags array<bigint>, doc_keys array<binary>"


def _scatter(docs: DataFrame, fragments: int, width: int, common: int) -> DataFrame:
    """Packed shingles by fragment, and the (doc_id, tag, node) of every row, of ``docs`` (doc_id, text, tag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[bytes, np.ndarray] = {}
        seen: list[tuple] = []
        total, turn = 0, TaskContext.get().partitionId()
        for batch in batches:
            for block in blocks(rows_of(batch), lambda r: len(r[1] or "")):
                for (doc, _, tag), tokens in zip(block, shingle_sets([t for _, t, _ in block], width)):
                    if not len(tokens):
                        seen.append((doc, tag, None))
                        continue
                    key = node_key(tokens)
                    seen.append((doc, tag, key))
                    if key not in held:
                        held[key] = tokens
                        total += len(tokens)
                if total >= HELD or len(seen) >= 200_000:
                    yield _send(list(held.items()), seen, fragments, common, turn)
                    held, seen, total, turn = {}, [], 0, turn + 1
                    release()
        if seen:
            yield _send(list(held.items()), seen, fragments, common, turn)

    return docs.mapInArrow(tidy(run), _SENT)


def _pairs(node: np.ndarray, first: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Codes a * N + b (a < b) of the pairs of each run, some runs at a time, sizes permitting a link."""
    total = len(sizes)
    for c in np.unique(counts):
        at = first[counts == c]
        i, j = np.triu_indices(int(c), 1)
        step = max(1, PAIRS_AT_ONCE // len(i))
        for s in range(0, len(at), step):
            own = node[at[s : s + step, None] + np.arange(c)[None, :]]
            x, y = own[:, i].ravel(), own[:, j].ravel()
            a, b = np.minimum(x, y), np.maximum(x, y)
            fit = LINK_DEN * np.minimum(sizes[a], sizes[b]) >= LINK_NUM * np.maximum(sizes[a], sizes[b])
            yield a[fit].astype(np.int64) * total + b[fit]


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _count_fragment(rows: pa.Table, common: int) -> Iterator[pa.Table]:
    """Partial overlaps (kind 0), nodes' common shingles (1) and rows' nodes (2) of one fragment."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("na", pa.int64()), ("nb", pa.int64()), ("v", pa.int64())])

    def out(kind: int, a, b, na, nb, v) -> pa.Table:
        n = len(v)
        fill = lambda x, ty: pa.nulls(n, ty) if x is None else pa.array(x, ty)
        columns = [pa.array([kind] * n, pa.int32()), fill(a, pa.binary()), fill(b, pa.binary()), fill(na, pa.int64()), fill(nb, pa.int64()), pa.array(v, pa.int64())]
        return pa.Table.from_arrays(columns, schema=schema)

    join = lambda name: b"".join(x for x in rows.column(name).to_pylist() if x)
    ids, tags, keys = ([v for x in rows.column(name).to_pylist() for v in x or ()] for name in ("docs", "tags", "doc_keys"))
    if ids:
        yield out(2, keys, None, tags, None, ids)
    key = np.frombuffer(join("keys"), np.uint8).reshape(-1, _KEY)
    if not len(key):
        return
    counts = np.frombuffer(join("counts"), "<u4").astype(np.int64)
    dropped = []
    for k, d in zip(rows.column("keys").to_pylist(), rows.column("dropped").to_pylist()):
        dropped.append(np.frombuffer(d, "<u4") if d else np.zeros(len(k) // _KEY, np.uint32))
    dropped = np.concatenate(dropped).astype(np.int64)
    tokens, hot = np.frombuffer(join("tokens"), np.uint64), np.unique(np.frombuffer(join("hot"), np.uint64))
    names, first, entry = np.unique(np.ascontiguousarray(key).view(f"V{_KEY}").ravel(), return_index=True, return_inverse=True)
    chosen = np.zeros(len(entry), bool)
    chosen[first] = True
    sizes = np.ascontiguousarray(key[first][:, -4:]).view(">u4").ravel().astype(np.int64)
    node = np.repeat(entry.astype(np.int32), counts)
    if not chosen.all():
        keep = np.repeat(chosen, counts)
        node, tokens = node[keep], tokens[keep]
    here = (counts + dropped)[first]
    order = np.argsort(tokens, kind="stable")
    tokens, node = tokens[order], node[order]
    del order
    start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(tokens)))
    is_hot = size > common
    if len(hot):
        is_hot |= np.isin(tokens[start], hot)
    n_hot = dropped[first] + np.bincount(node[np.repeat(is_hot, size)], minlength=len(names))
    text = [bytes(x) for x in key[first]]
    who = np.flatnonzero(n_hot)
    yield out(1, [text[i] for i in who], None, sizes[who], None, n_hot[who])
    found: tuple[list, list] = ([], [])
    waiting = 0
    some = ~is_hot & (size > 1)
    for code in _pairs(node, start[some], size[some], sizes):
        c, n = np.unique(code, return_counts=True)
        found[0].append(c)
        found[1].append(n)
        waiting += len(c)
        if waiting > PAIRS_AT_ONCE:
            c, n = _merge(*found)
            found, waiting = ([c], [n]), 0
    if found[0]:
        code, overlap = _merge(*found)
        a, b = code // len(names), code % len(names)
        # Beyond what a link allows to differ in all, a fragment's difference (common shingles left out) rules the pair out.
        apart = (here - n_hot)[a] + (here - n_hot)[b] - 2 * overlap
        fit = (LINK_NUM + LINK_DEN) * apart <= (LINK_DEN - LINK_NUM) * (sizes[a] + sizes[b])
        a, b, overlap = a[fit], b[fit], overlap[fit]
        yield out(0, [text[i] for i in a], [text[i] for i in b], sizes[a], sizes[b], overlap)


def _sets_of(docs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, n, tokens) of the wanted ``nodes``, from one of its rows each.

    A node's rows are reduced to one before they meet anything. The ids may be as
    many as the rows, so they meet the texts by a shuffle, at every size."""
    least = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = least.join(nodes.select("node"), "node", "left_semi").select(F.col("doc_id").alias("w")).distinct()
    picked = docs.join(wanted.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("w")), "left_semi")
    schema = pa.schema([("node", pa.binary()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks((r[1] for r in rows_of(batch)), lambda t: len(t or "")):
                sets = [s for s in shingle_sets(block, width) if len(s)]
                arrays = [[node_key(s) for s in sets], [len(s) for s in sets], [s.view(np.int64) for s in sets]]
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)

    made = picked.mapInArrow(tidy(run), "node binary, n long, tokens array<bigint>")
    return made.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets link, by intersecting them.

    Dealt by a bijection of the node's name, so that a leader's rows can be split."""
    left = sets.select(F.reverse(F.hex("node")).alias("ka"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.reverse(F.hex("node")).alias("kb"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    joined = (
        pairs.withColumns({"ka": F.reverse(F.hex("a")), "kb": F.reverse(F.hex("b"))}).join(left, "ka").join(right, "kb")
    )
    overlap = F.size(F.array_intersect("ta", "tb"))
    return joined.where(links(overlap, F.col("na"), F.col("nb"))).select("a", "b")


def _components(edges: DataFrame, few: int = 0) -> DataFrame:
    found = connected_components(edges.select(F.hex("a").alias("a"), F.hex("b").alias("b")), few=few)
    out = found.select(F.unhex("node").alias("node"), F.unhex("label").alias("label"))
    out.scratch_path = found.scratch_path
    return out


def _can_link(na, nb, sa, sb):
    """Whether sets of these sizes can link if at most ``sa`` and ``sb`` of their shingles are in any other set."""
    return links(F.least(sa, sb), na, nb)


def _prefix_postings(sets: DataFrame) -> DataFrame:
    """(node, n, s, token): the prefix of every set, rarest shingles (among ``sets``) first.

    ``s`` counts the set's shingles that some other of ``sets`` has: no overlap is larger.
    Two sets that link share a shingle of their prefixes, whatever the order; with
    the rarest first, sets that only share what is common meet seldom. Shingles of
    one set alone are left out: they meet nothing."""
    every = sets.select("node", "n", F.explode("tokens").alias("token")).withColumn("k", F.reverse(F.col("token").cast("string")))
    often = every.groupBy("token").agg(F.count("*").alias("often")).select(F.reverse(F.col("token").cast("string")).alias("k"), "often")
    ordered = every.join(often, "k").groupBy("node").agg(
        F.first("n").alias("n"), F.count_if(F.col("often") > 1).alias("s"), F.sort_array(F.collect_list(F.struct("often", "token"))).alias("all")
    )
    size = (F.col("n") - F.ceil(F.col("n") * F.lit(LINK_NUM) / F.lit(LINK_DEN)) + 1).cast("int")
    able = ordered.where(links(F.col("s"), F.col("n"), F.col("s")))
    return able.select("node", "n", "s", F.explode(F.slice("all", F.lit(1), size)).alias("p")).where("p.often > 1").select("node", "n", "s", "p.token")


def _within_groups(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges``, and links enough that every two linked nodes of ``sets`` are connected."""
    postings = cut(_prefix_postings(sets), "postings")
    total, before, labels, open_groups = postings.count(), None, None, None
    while True:
        found = _components(edges, FEW)
        labels = cut(found, "labels", found, *[t for t in (labels, open_groups) if t is not None])
        labelled = postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        groups = labelled.groupBy("token", "label").count()
        open_groups = cut(
            groups.groupBy("token").agg(
                F.sum("count").alias("size"), F.sum(F.col("count") * F.col("count")).alias("inner"),
                F.max(F.struct("count", "label")).alias("top"), F.count("*").alias("labels"),
            ).where("labels > 1").select("token", (F.col("size") * F.col("size") - F.col("inner")).alias("across"), F.col("top.label").alias("top")),
            "groups",
        )
        across = open_groups.agg(F.sum("across")).first()[0] or 0
        # Leaders have done their work when few pairs are left, or when a round changes little.
        if across <= 2 * PAIRS_PER_POSTING * total or before is not None and across > 0.7 * before:
            break
        before = across
        live = labelled.withColumn("k", F.reverse(F.col("token").cast("string"))).join(
            open_groups.select(F.reverse(F.col("token").cast("string")).alias("k"), "top"), "k"
        )
        draw = F.struct(F.xxhash64("node", F.lit(across)).alias("draw"), F.col("node").alias("leader"), F.col("label").alias("leader_label"), F.col("n").alias("leader_n"), F.col("s").alias("leader_s"))
        # Two leaders a shingle: one of its largest component, one of the rest.
        leaders = live.groupBy("token", (F.col("label") == F.col("top")).alias("side")).agg(F.min(draw).alias("l")).select(
            F.reverse(F.col("token").cast("string")).alias("k"), "l.leader", "l.leader_label", "l.leader_n", "l.leader_s"
        )
        fit = (F.col("label") != F.col("leader_label")) & _can_link(F.col("n"), F.col("leader_n"), F.col("s"), F.col("leader_s"))
        pairs = live.select("k", "node", "n", "s", "label").join(leaders, "k").where(fit).select(
            F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")
        ).distinct()
        edges = cut(edges.unionByName(_linked(pairs, sets)).distinct(), "edges", edges)
    if not across:
        discard(postings, labels, open_groups)
        return edges
    name = lambda c: F.hex(c)
    live = cut(
        labelled.withColumn("k", F.reverse(F.col("token").cast("string")))
        .join(open_groups.select(F.reverse(F.col("token").cast("string")).alias("k"), "top"), "k")
        .select("k", "node", "label", (F.col("label") != F.col("top")).alias("odd")), "live", postings, labels, open_groups,
    )
    # Sets that meet in some group, directly or through others, are a family.
    first = live.groupBy("k").agg(F.min(name("node")).alias("b")).select(F.reverse("k").alias("r"), "b")
    met = live.select(F.reverse("k").alias("r"), name("node").alias("a")).join(first, "r").select("a", "b").distinct()
    linked = connected_components(met, few=FEW)
    families = linked.select(F.unhex("node").alias("node"), F.col("label").alias("family"))
    members = live.groupBy("node").agg(F.first("label").alias("label"), F.max("odd").alias("odd")).join(families, "node")
    members = cut(members.withColumn("draw", F.pmod(F.xxhash64("node"), F.lit(1 << 20))), "families", live, linked)
    blocks_of = lambda n: F.greatest(F.ceil(n / CELL), F.lit(1)).cast("int")
    sizes = members.groupBy("family").agg(blocks_of(F.count("*")).alias("nb"), blocks_of(F.count_if("odd")).alias("no")).withColumnRenamed("family", "f")
    sized = members.withColumn("h", F.reverse("family")).join(sizes.select(F.reverse("f").alias("h"), "nb", "no"), "h").drop("h")
    every = F.sequence(F.lit(0), F.col("no") - 1)
    left = sized.where("odd").select("node", "label", "family", F.lit(0).alias("side"), (F.col("draw") % F.col("no")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    right = sized.select("node", "label", "family", F.lit(1).alias("side"), F.explode(every).alias("i"), (F.col("draw") % F.col("nb")).cast("int").alias("j"))
    keyed = lambda df: df.withColumn("h", F.reverse(F.hex("node")))
    cells = keyed(left.unionByName(right)).join(keyed(sets.select("node", "n", "tokens")).drop("node"), "h").drop("h")
    found = cells.groupBy("family", "i", "j").applyInArrow(lambda t: settled(_compare_cell(t)), "a binary, b binary")
    return cut(edges.unionByName(found), "edges", edges, members)


def _compare_cell(rows: pa.Table) -> pa.Table:
    """Links of a cell: each set of side 0 against each of side 1, as many as join different labels anew."""
    release()
    side, n = rows.column("side").to_numpy(), rows.column("n").to_numpy()
    node, label = rows.column("node").to_pylist(), rows.column("label").to_pylist()
    flat = rows.column("tokens").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    owner = np.repeat(np.arange(len(n)), flat.value_lengths().to_numpy(zero_copy_only=False))
    token, at, often = np.unique(flat.flatten().to_numpy(), return_inverse=True, return_counts=True)
    keep = often[at] > 1
    place = np.cumsum(often > 1) - 1
    owner, column = owner[keep], place[at[keep]]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    overlap = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        has = np.zeros((len(n), 4096), np.float32)
        has[owner[a:b], column[a:b] - start] = 1
        overlap += has[left] @ has[right].T
    code = np.unique(np.array([x.hex() for x in label]), return_inverse=True)[1]
    fit = links(overlap.astype(np.int64), n[left][:, None], n[right][None, :]) & (code[left][:, None] != code[right][None, :])
    i, j = np.nonzero(fit)
    _, one = np.unique(np.stack((code[left[i]], code[right[j]])), axis=1, return_index=True)
    pick = [(node[left[i[o]]], node[right[j[o]]]) for o in one]
    return pa.Table.from_arrays([pa.array([p[0] for p in pick], pa.binary()), pa.array([p[1] for p in pick], pa.binary())], names=["a", "b"])


def link_components(docs: DataFrame, width: int = WIDTH, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text",
                    tag_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    With ``tag_col``, a long that tells rows of one id apart, also tag and component, a
    name that no other component has (null for an empty set). The result reads scratch
    tables, which ``storage.discard`` of it deletes."""
    spark = docs.sparkSession
    tag = F.lit(None).cast("long") if tag_col is None else F.col(f"`{tag_col}`").cast("long")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), tag.alias("tag"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    fragments = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FRAGMENT_BYTES))
    sent = _scatter(docs, fragments, width, common)
    mixed = cut(sent.groupBy("part").applyInArrow(lambda t: settled(_count_fragment_table(t, common)), _MIXED), "counted")
    rows = mixed.where("kind = 2").select(F.col("v").alias("doc_id"), F.col("na").alias("tag"), F.col("a").alias("node"))
    hot = mixed.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.first("na").alias("n"), F.sum("v").alias("hot"))
    pairs = mixed.where("kind = 0").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("v").alias("o"))
    h = lambda k: hot.select(F.col("node").alias(k), F.col("hot").alias(f"h{k}"))
    scored = pairs.join(h("a"), "a", "left").join(h("b"), "b", "left")
    most = F.col("o") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    sure = links(F.col("o"), F.col("na"), F.col("nb"))
    scored = cut(scored.where(links(most, F.col("na"), F.col("nb"))).select("a", "b", sure.alias("sure")), "scored")
    edges = scored.where("sure").select("a", "b")
    unsure = scored.where("not sure").select("a", "b")
    grouped = hot.where(LINK_DEN * F.col("hot") >= LINK_NUM * F.col("n")).select("node")
    wanted = cut(
        grouped.withColumn("g", F.lit(1)).unionByName(unsure.select(F.explode(F.array("a", "b")).alias("node"), F.lit(0).alias("g")))
        .groupBy("node").agg(F.max("g").alias("g")), "wanted",
    )
    spent = [scored, wanted]
    if wanted.limit(1).count():
        sets = cut(_sets_of(docs, wanted, rows, width), "sets")
        edges = cut(edges.unionByName(_linked(unsure, sets)), "edges", scored)
        members = cut(sets.join(wanted.where("g = 1"), "node", "left_semi"), "members", sets)
        edges = _within_groups(members, edges)
        spent += [members, edges]
    labels = _components(edges)
    discard(*spent)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left")
    nodes = nodes.withColumn("label", F.coalesce("label", "node"))
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    key = lambda name: F.reverse(F.hex(name))
    named = nodes.select("node", "label", key("label").alias("k")).join(least.select(key("label").alias("k"), "component_id"), "k")
    named = named.select(key("node").alias("k"), F.col("label").alias("component"), "component_id", F.conv(F.substring(F.hex("node"), 2 * _KEY - 7, 8), 16, 10).cast("long").alias("n_shingles"))
    full = rows.where("node is not null").withColumn("k", key("node")).join(named, "k")
    none = {"n_shingles": F.lit(0).cast("long"), "component_id": F.col("doc_id"), "component": F.lit(None).cast("binary")}
    columns = ["doc_id", "n_shingles", "component_id", *["tag", "component"] * (tag_col is not None)]
    out = full.select(*columns).unionByName(rows.where("node is null").withColumns(none).select(*columns))
    out.reads = [mixed, labels]
    return out


def _count_fragment_table(rows: pa.Table, common: int) -> pa.Table:
    release()
    found = list(_count_fragment(rows, common))
    if found:
        return pa.concat_tables(found)
    schema = [("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("na", pa.int64()), ("nb", pa.int64()), ("v", pa.int64())]
    return pa.Table.from_pylist([], schema=pa.schema(schema))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: components of all documents."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS grams FROM w
), g AS (SELECT doc_id, md5_number_lower(unnest(grams)) AS gram FROM s),
n AS (SELECT doc_id, len(grams) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.reached) AS component_id
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
