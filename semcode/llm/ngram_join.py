"""N-gram Jaccard join over prefix trees, reduced to connected components.

Two texts link when the Jaccard similarity of their sets of word n-grams is at
least ``num / den``.  The result is one row per document with its component;
equal sets are one class, and no pairs are listed.

1. *Blocks.*  Set sizes fall into classes such that linked sets lie in one class
   or in neighbouring ones.  At each of the two levels a set's n-grams are dealt
   by hash into more segments than the greatest symmetric difference a link of
   that level allows (plus a reserve against empty segments), so linked sets
   share at least one equal, non-empty segment.  Sets with an equal segment are
   joined to blocks.  No link crosses blocks; segments hold several n-grams, so
   common words, lines or passages alone do not make a block.  Chains of segments
   do: prefix filtering cuts every block into the parts that may hold a link.
2. *Prefix trees.*  The sets of a block, ordered by frequency and hash, are stored
   in a compressed trie.  Each set traverses it level by level: overlaps are
   counted once per shared path, and a subtree is pruned when its sizes, or the
   overlap so far plus the remaining lengths, cannot reach the threshold.
3. Links that unite two components are kept as a forest; components come from a
   distributed star contraction.

Skew: equal sets travel as one fingerprint per batch; a segment key that many
sets share costs one row per batch; a block above ``cell_grams`` n-grams is cut
into chunks that meet chunk 0 first, and only members left outside the block's
largest component are then compared with all other chunks.  Every task holds at
most two chunks (or one document).

N-grams are 64-bit hashes, sets 128-bit fingerprints.

Defined cases: null or empty text has an empty set and links with nothing; a
text with fewer than ``k`` words has one shingle, the whole sequence; rows with
the same id count as one node (both texts' links hold); a null id gets a null
component and bridges nothing; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semcode.llm.bytesnp import LOWER, SpanHash, chunks, mix, utf8, word_spans
from semcode.llm.shared import components, discard, materialize, tidy

CELL_GRAMS = 2_000_000
REFINE_GRAMS = 0  # blocks above it are cut by prefixes first; 0: all, so that the work grows with their sets
_M = np.random.Generator(np.random.PCG64(815)).integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)


class Levels:
    """Size classes and, per level, greatest difference and number of segments."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 40:
            low.append(den * low[-1] // num + 1)
        self.low = np.array(low, np.int64)
        n = self.low[1:] - 1
        m = den * n // num
        self.diff = (den - num) * (n + m) // (den + num)
        self.spare = 3 + self.diff // 16
        self.segments = self.diff + 1 + self.spare

    def of(self, n: int):
        """Levels at which a set of size n can have partners of another set."""
        c = int(np.searchsorted(self.low, n, side="right")) - 1
        if c > 0 and self.num * n <= self.den * (self.low[c] - 1) and self.diff[c - 1] > 0:
            yield c - 1
        if self.diff[c] > 0:
            yield c


def shingle_sets(col, k: int):
    """(row, sorted distinct 64-bit n-gram hashes) of every non-empty text."""
    data, offs = utf8(col)
    for i, j in chunks(offs):
        buf, rel = LOWER[data[offs[i]:offs[j]]], offs[i:j + 1] - offs[i]
        starts, ends, at = word_spans(buf, rel)
        if not len(starts):
            continue
        w = SpanHash(buf)(starts, ends)
        grams = np.zeros(max(0, len(w) - k + 1), np.uint64)
        for x in range(k):
            grams += w[x:len(w) - k + 1 + x] * _M[x]
        grams = mix(grams)
        for d in range(j - i):
            a, b = at[d], at[d + 1]
            if b - a >= k:
                yield i + d, np.unique(grams[a:b - k + 1])
            elif b > a:
                short = np.zeros(1, np.uint64)
                for x in range(b - a):
                    short += w[a + x:a + x + 1] * _M[x]
                yield i + d, mix(short + _M[k + (b - a)])


def fingerprint(s: np.ndarray) -> tuple[np.int64, np.int64]:
    with np.errstate(over="ignore"):
        a = mix(np.array([np.add.reduce(mix(s ^ _M[40])), np.add.reduce(mix(s ^ _M[41]))]) + np.uint64(len(s)))
    return tuple(a.view(np.int64))


def segment_keys(s: np.ndarray, levels: Levels) -> np.ndarray:
    out = []
    for c in levels.of(len(s)):
        n = int(levels.segments[c])
        at = (s % np.uint64(n)).astype(np.int64)
        own = mix(s ^ _M[42])
        count = np.bincount(at, minlength=n)
        low = np.bincount(at, (own & _LOW).astype(np.float64), n).astype(np.uint64)
        high = np.bincount(at, (own >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
        key = mix(low + (high << np.uint64(32)) + mix(np.arange(n, dtype=np.uint64) * _M[43] + np.uint64(c << 32)))
        full = count > 0
        out.append(key if n - full.sum() > levels.spare[c] else key[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_ROWS = "kind tinyint, a long, b long, c long, n int"
DOC, KEY, EDGE = 0, 1, 2


def _batch(kind, a, b, c, n):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(b), kind, np.int8)), a if isinstance(a, pa.Array) else pa.array(a, pa.int64()),
         pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32())], names=["kind", "a", "b", "c", "n"])


def _stars(key: np.ndarray, fp: np.ndarray):
    """Sorted by key: (key, smallest member) rows and (member, smallest) edges."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    low = fp[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = fp != low
    edges = np.unique(np.stack([fp[other], low[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return key[new], fp[new], edges


def _key_rows(k: int, num: int, den: int):
    levels = Levels(num, den)

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            fp, fp2, size = (np.zeros(rows, np.int64) for _ in range(3))
            keys, owner, seen = [], [], set()
            for r, s in shingle_sets(batch.column(1), k):
                fp[r], fp2[r] = fingerprint(s)
                size[r] = len(s)
                if fp[r] not in seen:
                    seen.add(fp[r])
                    got = segment_keys(s, levels)
                    keys.append(got)
                    owner.append(np.full(len(got), fp[r], np.int64))
            yield _batch(DOC, batch.column(0), fp, fp2, size)
            if keys:
                key, own, edges = _stars(np.concatenate(keys).view(np.int64), np.concatenate(owner))
                zero = np.zeros(len(key), np.int64)
                yield _batch(KEY, key, own, zero, zero)
                zero = np.zeros(len(edges), np.int64)
                yield _batch(EDGE, edges[:, 0], edges[:, 1], zero, zero)
    return run


def _meet(batches):
    """Rows of one partition: keys with several members become edges."""
    key, own = [], []
    for b in batches:
        kind = b.column(0).to_numpy()
        if (kind != KEY).any():
            yield b.filter(pa.array(kind != KEY))
        at = kind == KEY
        a = b.column(1).to_numpy(zero_copy_only=False)[at].astype(np.int64)
        key.append(a)
        own.append(b.column(2).to_numpy()[at])
    if key:
        key, own = np.concatenate(key), np.concatenate(own)
        if len(key):
            _, _, edges = _stars(key, own)
            zero = np.zeros(len(edges), np.int64)
            yield _batch(EDGE, edges[:, 0], edges[:, 1], zero, zero)


class Trie:
    """Path-compressed prefix tree over sorted integer sequences.

    Sequences in lexicographic order share with their predecessor a prefix of
    ``lcp`` items; each stores only the rest and hangs on the path of its parent
    at that depth.  Nodes are laid out by level, so that one traversal step
    handles a whole level."""

    def __init__(self, seqs: list[np.ndarray], levels: Levels):
        keys = [s.astype(">u4").tobytes() for s in seqs]
        order = sorted(range(len(seqs)), key=keys.__getitem__)
        k = len(order)
        lcp, parent, level = np.zeros(k, np.int64), np.full(k, -1), np.zeros(k, np.int64)
        size = np.array([len(seqs[o]) for o in order])
        most, least, stack = size.copy(), size.copy(), []
        for i, o in enumerate(order):
            if i:
                a, b = seqs[o], seqs[order[i - 1]]
                m = min(len(a), len(b))
                same = a[:m] == b[:m]
                lcp[i] = m if same.all() else int(np.argmin(same))
            while stack and lcp[stack[-1]] >= lcp[i]:
                stack.pop()
            if lcp[i]:
                parent[i] = stack[-1]
                level[i] = level[parent[i]] + 1
            stack.append(i)
        for i in range(k - 1, -1, -1):
            if parent[i] >= 0:
                most[parent[i]] = max(most[parent[i]], most[i])
                least[parent[i]] = min(least[parent[i]], least[i])
        by = np.argsort(level, kind="stable")
        place = np.empty(k, np.int64)
        place[by] = np.arange(k)
        self.rows = np.array(order)[by]
        self.lcp, self.size, self.most, self.least = lcp[by], size[by], most[by], least[by]
        self.parent = np.where(parent[by] >= 0, place[parent[by]], -1)
        self.last = np.array([seqs[order[i]][lcp[i] - 1] if lcp[i] else -1 for i in by])
        rest = [seqs[order[i]][lcp[i]:] for i in by]
        self.edge = np.concatenate(rest) if rest else np.zeros(0, np.int64)
        self.length = np.array([len(r) for r in rest], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.cuts = np.searchsorted(level[by], np.arange(level.max(initial=0) + 2))
        self.num, self.den = levels.num, levels.den

    def linked(self, q: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Rows whose set links with ``q``; ``hit`` marks q's items."""
        num, den, m = self.num, self.den, len(q)
        out, base = [], np.zeros(len(self.rows), np.int64)
        alive = np.zeros(len(self.rows), bool)
        at = np.zeros(len(self.rows), np.int64)  # of an alive node: its first place in the level's sums
        sums = np.zeros(1, np.int64)
        for lo, hi in zip(self.cuts[:-1], self.cuts[1:]):
            i = np.arange(lo, hi)
            up = self.parent[i]
            if lo:
                i, up = i[alive[up]], up[alive[up]]
                base[i] = base[up] + sums[at[up] + self.lcp[i] - self.lcp[up]] - sums[at[up]]
            d, o = self.lcp[i], base[i]
            left = m - np.searchsorted(q, self.last[i], side="right")
            i = i[(den * self.most[i] >= num * m) & (den * m >= num * self.least[i])
                  & ((num + den) * (o + self.most[i] - d) >= num * (self.most[i] + m))
                  & ((num + den) * (o + left) >= num * (self.least[i] + m))]
            if not len(i):
                break
            alive[i] = True
            n = self.length[i]
            first = np.cumsum(n) - n
            flat = np.repeat(self.start[i] - first, n) + np.arange(n.sum())
            sums = np.concatenate(([0], np.cumsum(hit[self.edge[flat]])))
            at[i] = first
            total = base[i] + sums[first + n] - sums[first]
            out.append(i[(num + den) * total >= num * (self.size[i] + m)])
        return self.rows[np.concatenate(out)] if out else np.zeros(0, np.int64)


def forest(sets: list[np.ndarray], index: np.ndarray, probe: np.ndarray, levels: Levels) -> list[tuple[int, int]]:
    """Links between ``index`` and ``probe`` sets, as far as they unite components."""
    cuts = np.cumsum([0, *map(len, sets)])
    grams, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, -count))] = np.arange(len(grams))  # common ones first: longest shared paths
    seqs = [np.sort(rank[at[cuts[i]:cuts[i + 1]]]) for i in range(len(sets))]
    rows = np.flatnonzero(index)
    trie = Trie([seqs[i] for i in rows], levels)
    comp = np.arange(len(sets))
    hit = np.zeros(len(grams), bool)
    out = []
    for p in np.flatnonzero(probe):
        if (comp[rows] == comp[p]).all():
            if (comp == comp[p]).all():
                break
            continue
        hit[seqs[p]] = True
        near = rows[trie.linked(seqs[p], hit)]
        hit[seqs[p]] = False
        for c in np.unique(comp[near]):
            if c != comp[p]:
                out.append((p, near[comp[near] == c][0]))
                comp[comp == c] = comp[p]
    return out


def _cell(k: int, num: int, den: int):
    """One cell: rows (rep, fp, text, side); side 0 both, 1 index only, 2 probe only."""
    def run(t: pa.Table) -> pa.Table:
        levels = Levels(num, den)
        rep, fp, side = (t.column(c).to_numpy() for c in ("rep", "fp", "side"))
        got: dict[tuple, int] = {}
        sets, owner, sides = [], [], []
        for r, s in shingle_sets(t.column("text"), k):
            if fingerprint(s)[0] != fp[r] or (rep[r], fp[r], side[r]) in got:
                continue  # another text under the same id, or a repeated row
            got[(rep[r], fp[r], side[r])] = r
            sets.append(s)
            owner.append(rep[r])
            sides.append(side[r])
        sides = np.array(sides)
        links = forest(sets, sides != 2, sides != 1, levels) if len(sets) > 1 else []
        return pa.table({"a": pa.array([owner[x] for x, _ in links], pa.int64()),
                         "b": pa.array([owner[y] for _, y in links], pa.int64())})
    return run


def _gram_rows(k: int):
    """Member rows (block, fp, text) to (key, fp) per n-gram, the key within its block."""
    def run(batches):
        def rows():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owner))], names=["key", "fp"])

        for b in batches:
            block, fp = (b.column(i).to_numpy() for i in range(2))
            keys, owner, held = [], [], 0
            for r, s in shingle_sets(b.column(2), k):
                if fingerprint(s)[0] == fp[r]:
                    keys.append(mix(s ^ mix(block[r:r + 1].view(np.uint64))).view(np.int64))
                    owner.append(np.full(len(s), fp[r]))
                    held += len(s)
                    if held > 200_000:
                        yield rows()
                        keys, owner, held = [], [], 0
            if held:
                yield rows()
    return run


def _refined(members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(fp, part)``: the parts into which prefix filtering cuts the given blocks;
    sets without a possible partner do not appear."""
    per_key = Window.partitionBy("key")
    rows = members.select("block", "fp", "text").mapInArrow(tidy(_gram_rows(k)), "key long, fp long")
    shared = (rows.withColumn("df", F.count("*").over(per_key)).withColumn("lo", F.min("fp").over(per_key))
              .withColumn("hi", F.max("fp").over(per_key)).where("lo <> hi"))
    lists = shared.groupBy("fp").agg(F.sort_array(F.collect_set(F.struct("df", "key"))).alias("g"))
    prefix = lists.join(members.groupBy("fp").agg(F.max("n").alias("n")), "fp").withColumn(
        "take", F.expr(f"cast(n - ceil({num} * n / {den}) + 1 - (n - size(g)) as int)"))
    keys = prefix.where("take > 0").select("fp", F.explode(F.expr("slice(g, 1, take)")).alias("x")).select("fp", "x.key")
    edges = keys.withColumn("b", F.min("fp").over(per_key)).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return components(edges, "parts").select(F.col("node").alias("fp"), F.col("component").alias("part"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                     num: int = 80, den: int = 100, cell_grams: int = CELL_GRAMS,
                     refine_grams: int = REFINE_GRAMS) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` per row; link: ``den * |A & B| >= num * |A | B|``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    met = materialize(d.mapInArrow(tidy(_key_rows(k, num, den)), _ROWS).repartition("a").mapInArrow(tidy(_meet), _ROWS), "keys")
    own = met.where(f"kind = {DOC}").select(F.col("a").alias("doc"), F.col("b").alias("fp"), F.col("c").alias("fp2"), "n")
    blocks = components(met.where(f"kind = {EDGE}").select("a", "b"), "blocks")
    classes = own.where("n > 0 and doc is not null").groupBy("fp", "fp2", "n").agg(F.min("doc").alias("rep"))
    members = classes.join(blocks, F.col("fp") == F.col("node")).select("rep", "fp", "n", F.col("component").alias("block"))
    several = lambda m: m.groupBy("block").agg(F.sum("n").alias("grams"), F.count("*").alias("k")).where("k > 1")
    members = members.join(several(members).select("block", "grams"), "block")
    members = materialize(members.join(d, F.col("rep") == F.col("doc")).drop("doc"), "members")
    if (members.agg(F.max("grams")).first()[0] or 0) > refine_grams:
        large = members.where(F.col("grams") > refine_grams)
        part = _refined(large, k, num, den)
        whole = members
        members = materialize(members.where(F.col("grams") <= refine_grams).drop("grams").unionByName(
            large.drop("grams", "block").join(part, "fp").withColumn("block", F.xxhash64(F.lit(1), "part")).drop("part")), "members")
        discard(whole)
    else:
        members = members.drop("grams")
    totals = several(members.select("block", "rep", "n").distinct()).select(
        "block", F.expr(f"cast(ceil(grams / {cell_grams}) as int)").alias("parts"))
    members = members.join(totals, "block").withColumn("chunk", F.expr("cast(pmod(xxhash64(rep), parts) as int)"))

    def compare(cells):
        return cells.groupBy("block", "i", "j").applyInArrow(_cell(k, num, den), "a long, b long")

    first = compare(members.select(
        "block", "rep", "fp", "text", F.lit(0).alias("i"),
        F.explode(F.expr("if(chunk = 0, sequence(0, parts - 1), array(chunk))")).alias("j"),
        F.expr("if(chunk = 0, 1, 2)").alias("side")).withColumn("side", F.expr("if(j = 0, 0, side)")))
    links = materialize(first, "links")
    if (members.agg(F.max("parts")).first()[0] or 1) > 1:
        # blocks beyond one cell: what chunk 0 did not join to the largest component
        comp = components(links, "part")
        big = (members.where("parts > 1").select("block", "rep", "n", "chunk")
               .join(comp, F.col("rep") == F.col("node"), "left")
               .withColumn("c", F.coalesce("component", "rep")))
        sizes = big.groupBy("block", "c").agg(F.count("*").alias("k"))
        top = sizes.groupBy("block").agg(F.max_by("c", F.struct("k", "c")).alias("top"))
        rest = big.where("chunk > 0").join(top, "block").where("c <> top")
        over = rest.groupBy("block").agg(F.expr(f"cast(ceil(sum(n) / {cell_grams}) as int)").alias("bins"))
        rest = rest.join(over, "block").select(
            "rep", F.col("block").alias("rb"), F.expr("cast(pmod(xxhash64(rep, 7), bins) as int)").alias("i"))
        texts = members.where("chunk > 0")
        index = (texts.join(rest, ["rep"]).where("block = rb")
                 .select("block", "rep", "fp", "text", "i", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("j"),
                         F.lit(1).alias("side")))
        probe = (texts.join(over, "block")
                 .select("block", "rep", "fp", "text", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("i"),
                         F.col("chunk").alias("j"), F.lit(2).alias("side")))
        links = links.union(materialize(compare(index.union(probe)), "links"))
    # rows sharing an id are one node: its classes belong together
    shared = (own.where("n > 0 and doc is not null").join(classes, ["fp", "fp2", "n"]).groupBy("doc")
              .agg(F.collect_set("rep").alias("reps")).where("size(reps) > 1")
              .select(F.explode("reps").alias("a"), F.array_min("reps").alias("b")))
    comp = components(links.union(shared), "docs")
    of = classes.join(comp, F.col("rep") == F.col("node"), "left").select(
        "fp", "fp2", "n", F.coalesce("component", "rep").alias("found"))
    out = own.join(of, ["fp", "fp2", "n"], "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("doc").isNotNull(), F.coalesce("found", "doc")).alias("component_id"))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with its columns, without the documents whose component has a smaller id."""
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__g")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__g"), "left_anti").select(*docs.columns)
