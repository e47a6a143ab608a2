"""Near-duplicate documents by SetSketch registers (operator 4).

A document is the set of its distinct word shingles.  Register i of its sketch holds floor(1 - log_b x), cut to 16 bits,
where x is the least of the exponential values (rate RATE) that function i gives to the set's shingles: minima on an
exponential scale.  Registers of a union are the larger ones, and two sets agree in a register the more often the more
alike they are: with probability of at least log_b(1 + J (b - 1)), 0.800 at Jaccard similarity J = 0.8.  Sets with nothing
in common agree with probability (b - 1) / (b + 1), which for b = 1.001 keeps them out of each other's buckets.

Search: the 128 registers form 32 bands of 4; sets that agree in a band share a bucket.  A pair at J = 0.8 shares none
with probability (1 - 0.8 ** 4) ** 32 = 4.7e-8.  Pairs from buckets are estimated by the joint likelihood of
how many registers are greater, less and equal; an estimate under CUTOFF is more than five standard deviations from
0.8 and is dropped.  The rest are confirmed on the full sets.

Equal sets are one node.  Each node meets the smallest of each of its buckets first, and the most alike of these is
confirmed.  Then what is not connected meets: buckets whose nodes are one
component are done, in the others the nodes of different components are compared register by register within cells, so
that no pair inside a component is written.  Likely partners go on as an array per node and part of the partners' sets; a
task holds one such part, confirms until the components are connected, and hands on a forest of links.  A pair is never a
row; in a large group of texts that are alike by less than the threshold the arrays hold nearly all its pairs.

Shingles are 64-bit hashes of their words; all sets stay apart unless those collide.  Sets are told apart by two sums of
their hashes and their size, and numbered as they are stored; the same steps are taken for any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import LOWER, UNBLANK, Hasher, Texts, batches, in_arrow, mixed, stored
from marginalia.llm.components import chains, connected

REGISTERS, BANDS = 128, 32
SCALE, RATE = 1.001, 20.0
CUTOFF = 0.6
BLOCK = 2048
PART_BYTES = 16 << 20  # sets of partners that a task holds, and sets that it holds against them at a time

_FACTORS = np.random.default_rng(11).integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one of none is empty."""
    batch = Texts(texts)
    batch.data = LOWER[batch.data]
    starts, ends, firsts = batch.words(UNBLANK)
    hashes = Hasher(batch.data).spans(starts, ends)
    whole = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        whole = whole * _STEP + hashes[k : k + len(whole)]
    whole = mixed(whole)
    sets = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(whole[a : b - words + 1]))
        else:
            value = np.zeros(min(1, b - a), np.uint64)
            for k in range(a, b):
                value = value * _STEP + hashes[k]
            sets.append(mixed(value + np.uint64(b - a)))
    return sets


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two sums that tell sets apart, a line each."""
    sums = [(mixed(s).sum(dtype=np.uint64), mixed(s * _STEP).sum(dtype=np.uint64)) for s in sets]
    return np.array(sums, dtype=np.uint64).reshape(-1, 2).view(np.int64)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets, a line each."""
    values = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.stack([np.minimum.reduceat(values * factor, begins) for factor in _FACTORS], axis=1)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300) / RATE) / np.log(SCALE)), 0, 65535).astype("<u2")


def similarity(greater: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of sets of sizes ``n`` and ``m`` by the registers that are greater and less."""
    share = (n / (n + m))[:, None]
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(n / m, m / n)[:, None]
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)
    up, down = chance(share - (1 - share) * grid), chance((1 - share) - share * grid)
    same = np.maximum(1 - up - down, 1e-12)
    equal = REGISTERS - greater - less
    log = lambda p: np.log(np.maximum(p, 1e-12))
    likelihood = greater[:, None] * log(up) + less[:, None] * log(down) + equal[:, None] * log(same)
    return np.take_along_axis(grid, likelihood.argmax(axis=1)[:, None], axis=1)[:, 0]


def alike(first: np.ndarray, second: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = np.concatenate([first, second])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


SIGNED = "doc long, id long, n long, high long, low long, registers binary"


def sign(docs: DataFrame, words: int) -> DataFrame:
    """(doc, id, n, high, low, registers) per row of ``docs`` (doc, id, text): size, digest and sketch of its shingle set."""

    def signed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in batches(stream):
            sets = shingle_sets(texts, words)
            full = [i for i, s in enumerate(sets) if len(s)]
            registers: list[bytes | None] = [None] * len(sets)
            if full:
                for i, line in zip(full, sketch([sets[i] for i in full]), strict=True):
                    registers[i] = line.tobytes()
            sums = digests(sets)
            columns = [rest.column(c).combine_chunks() for c in ("doc", "id")] + [pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "id", "n", "high", "low", "registers"])

    return in_arrow(docs, signed, SIGNED)


def band_keys(registers: Column) -> Column:
    width = 2 * REGISTERS // BANDS
    return F.array(*[F.xxhash64(F.lit(b), F.substring(registers, b * width + 1, width)) for b in range(BANDS)])


class Search:
    """Near duplicates among ``docs`` (doc, id, text): ``doc`` names an id and its text, so two texts of one id are two nodes."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent
        self.signed = stored(sign(docs, words), "sketches")
        full = self.signed.filter("n > 0")
        nodes = full.groupBy("high", "low", "n").agg(F.min("doc").alias("doc"), F.min("id").alias("id"), F.any_value("registers").alias("registers"))
        self.nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "shingle-sets")
        banded = self.nodes.select(F.posexplode(band_keys(F.col("registers"))).alias("band", "key"), "node")
        hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last")
        self.buckets = stored(banded.join(hubs.select("key", "hub"), "key"), "buckets")

    def components(self) -> DataFrame:
        """(node, component) of the nodes that have a link."""
        stars = self.buckets.filter("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        stars = stored(self.likely(stars), "candidates")
        nodes = stored(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
        shingles = self.shingles(nodes)
        best = stars.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a"))
        found = stored(chains(self.confirmed(best, shingles)), "components")
        return self.joined_across(found, nodes, shingles)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` whose sizes allow the similarity and whose registers make it likely, with the estimate."""
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
        known = pairs.join(side("a"), "a").join(side("b"), "b")
        sized = known.filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))

        def estimate(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                registers = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("r_a", "r_b")]
                greater, less = (registers[0] > registers[1]).sum(axis=1), (registers[0] < registers[1]).sum(axis=1)
                sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
                value = similarity(greater, less, *sizes) if batch.num_rows else np.zeros(0)
                columns = [batch.column("a"), batch.column("b"), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "estimate"]).filter(pa.array(value >= CUTOFF))

        return in_arrow(sized.select("a", "b", "n_a", "n_b", "r_a", "r_b"), estimate, "a long, b long, estimate double")

    def shingles(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of ``nodes``, as sorted 64-bit numbers, from the texts of their documents."""
        words = self.words

        def listed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rest, texts in batches(stream):
                sets = shingle_sets(texts, words)
                # A document is found by a hash; one whose set has another digest is not meant.
                asked = np.stack([rest.column(c).to_numpy() for c in ("high", "low")], axis=1)
                meant = pa.array((digests(sets) == asked).all(axis=1))
                values = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([rest.column("node").combine_chunks(), values], names=["node", "shingles"]).filter(meant)

        asked = nodes.join(self.nodes.select("node", "doc", "high", "low"), "node")
        return stored(in_arrow(self.docs.select("doc", "text").join(asked, "doc"), listed, "node long, shingles binary"), "shingles")

    def confirmed(self, pairs: DataFrame, shingles: DataFrame) -> DataFrame:
        """``pairs`` (a, b) that reach the similarity on their full sets."""
        percent = self.percent

        def check(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                right = []
                for a, b in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True):
                    right.append(alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent))
                yield batch.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

        side = lambda c: shingles.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))
        both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "s_a", "s_b")
        return in_arrow(both, check, "a long, b long").distinct()

    def joined_across(self, found: DataFrame, nodes: DataFrame, shingles: DataFrame) -> DataFrame:
        """``found`` with the links between its components; ``shingles`` has the sets of ``nodes``."""
        lists, partners = self.across(found)
        if partners is None:
            return found
        size = self.nodes.select("node", (8 * F.col("n")).alias("bytes"))
        lists = lists.groupBy("node", "component", "part").agg(F.flatten(F.collect_list("others")).alias("others"))
        lists = stored(lists.join(size, "node").withColumn("bytes", F.col("bytes") + 8 * F.size("others")), "candidates")
        more = lists.select("node").union(partners.select("node")).distinct().join(nodes, "node", "left_anti")
        shingles = shingles.unionByName(self.shingles(stored(more, "nodes")))
        # As many tasks take a part as the sets held against it need.
        tasks = lists.groupBy("part").agg(F.ceil(F.sum("bytes") / PART_BYTES).cast("int").alias("tasks"))
        left = lists.join(tasks, "part").withColumn("task", F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int"))
        left = left.select("part", "task", "node", "component", "others").join(shingles, "node")
        right = partners.join(tasks, "part").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
        right = right.select("part", "task", "node", "component").join(shingles.withColumnRenamed("shingles", "known"), "node")
        percent = self.percent

        def confirm(asked: pa.Table, known: pa.Table) -> pa.Table:
            sets = {n: (c, s) for n, c, s in zip(*[known.column(k).to_pylist() for k in ("node", "component", "known")], strict=True)}
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    root[c] = root.get(root[c], root[c])
                    c = root[c]
                return c

            links = []
            for node, own, others, mine in zip(*[asked.column(k).to_pylist() for k in ("node", "component", "others", "shingles")], strict=True):
                first = np.frombuffer(mine, np.uint64)
                for other in others:
                    component, second = sets[other]
                    a, b = find(own), find(component)
                    if a != b and alike(first, np.frombuffer(second, np.uint64), percent):
                        root[a] = b
                        links.append((min(node, other), max(node, other)))
            one, two = zip(*links, strict=True) if links else ((), ())
            return pa.table([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

        links = left.groupBy("part", "task").cogroup(right.groupBy("part", "task")).applyInArrow(confirm, "a long, b long")
        return stored(connected(found, stored(links, "links")), "components")

    def across(self, found: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Likely partners in buckets that hold several components, as (node, component, part, others), and where the
        partners' sets are, as (node, component, part); None if there is no such bucket.

        Of each bucket the largest component's nodes meet the others' and the others' meet one another, in blocks of
        BLOCK nodes; a cell of two blocks is one group.  Partners that share buckets are put into the same parts.
        """
        labelled = self.buckets.select("key", "band", "node").join(found, "node", "left")
        labelled = labelled.select("key", "band", "node", F.coalesce("component", "node").alias("component"))
        per = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        whole = per.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("big")).filter("all > big.n")
        whole = whole.select("key", F.col("big.component").alias("main"), F.ceil(F.col("big.n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("big.n")) / BLOCK).cast("int").alias("others"))
        rows = labelled.join(whole, "key").withColumn("is_main", F.col("component") == F.col("main"))
        homes = rows.filter("not is_main").groupBy("node", "component").agg(F.min("key").alias("home"))
        homes = stored(homes.join(self.nodes.select("node", "n"), "node"), "homes")
        held = homes.agg(F.sum(8 * F.col("n"))).first()[0]
        if not held:
            return None, None
        # A home whose sets are more than a part is split; all homes are dealt to as many parts as all sets need.
        split = homes.groupBy("home").agg(F.ceil(F.sum(8 * F.col("n")) / PART_BYTES).alias("pieces"))
        piece = F.pmod(F.xxhash64("node"), F.col("pieces"))
        part = F.pmod(F.xxhash64("home", piece), F.lit(-(-held // PART_BYTES))).cast("int")
        partners = stored(homes.join(split, "home").select("node", "component", part.alias("part")), "partners")
        block = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
        rows = rows.withColumn("block", block)
        cell = lambda kind, x, y, left: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), F.lit(left).alias("left"))
        span = lambda low, high, make: F.transform(F.sequence(low, high), make)
        zero, own = F.lit(0), F.col("block")
        of_main = span(zero, F.col("others") - 1, lambda y: cell(0, own, y, True))
        of_other = F.concat(
            span(zero, F.col("mains") - 1, lambda x: cell(0, x, own, False)),
            span(own, F.col("others") - 1, lambda y: cell(1, own, y, True)),
            span(zero, own, lambda x: cell(1, x, own, False)),
        )
        cells = rows.select("key", "band", "node", "component", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other)).alias("c"))
        met = cells.select("key", "band", "node", "component", "c.*").join(self.nodes.select("node", "n", "registers"), "node")
        met = met.join(partners.select("node", "part"), "node", "left")
        percent = self.percent

        def compare(group: pa.Table) -> pa.Table:
            left, right = group.filter(group.column("left")), group.filter(pc.invert(group.column("left")))
            get = lambda t, c: t.column(c).to_numpy()
            lines = lambda t: np.frombuffer(b"".join(t.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
            a, b, ca, cb = get(left, "node"), get(right, "node"), get(left, "component"), get(right, "component")
            na, nb, ra, rb = get(left, "n"), get(right, "n"), lines(left), lines(right)
            band, part = group.column("band")[0].as_py(), right.column("part").to_numpy()
            found: list[tuple] = []
            for i in range(len(a)):
                fit = (ca[i] != cb) & (100 * np.minimum(na[i], nb) >= percent * np.maximum(na[i], nb))
                spot = np.nonzero(fit)[0]
                same = ra[i] == rb[spot]
                first = same.reshape(len(spot), BANDS, REGISTERS // BANDS).all(axis=2).argmax(axis=1)  # a pair counts in its first band only
                spot = spot[(same.sum(axis=1) >= CUTOFF * REGISTERS) & (first == band)]
                for one in np.unique(part[spot]):
                    found.append((a[i], ca[i], one, b[spot][part[spot] == one]))
            nodes, components, parts, others = zip(*found, strict=True) if found else ((), (), (), ())
            columns = [pa.array(nodes, pa.int64()), pa.array(components, pa.int64()), pa.array(parts, pa.int32()), pa.array(others, pa.list_(pa.int64()))]
            return pa.table(columns, names=["node", "component", "part", "others"])

        lists = met.groupBy("key", "kind", "x", "y").applyInArrow(compare, "node long, component long, part int, others array<long>")
        return lists, partners


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept.

    ``doc_id`` must be whole numbers.  Texts are split at blanks, A-Z in lower case, shingles are ``words`` words.
    Texts without words are linked with nothing and kept; so are rows without a doc_id, whose component is null.
    Rows with equal sets belong together; a row is ``kept`` if its doc_id is its component's.  Further columns are
    ignored.
    """
    rows = identified(docs)
    named = judged_rows(rows, words, percent).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    result = named.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    missing = sign(rows.filter("id is null"), words)
    missing = missing.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return result.unionByName(missing)


def row_key() -> Column:
    """A 64-bit hash of a row's doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("doc"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def judged_rows(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc, id, n, component, component_id) of ``rows`` that have an id; ``component`` is null for texts without words."""
    search = Search(rows.filter("id is not null"), words, percent)
    known = search.nodes.select("high", "low", "n", "node", F.col("id").alias("own"))
    linked = known.join(search.components(), "node", "left")
    least = linked.filter("component is not null").groupBy("component").agg(F.min("own").alias("least"))
    classes = linked.join(least, "component", "left")
    classes = classes.select("high", "low", "n", F.coalesce("component", "node").alias("component"), F.coalesce("least", "own").alias("least"))
    named = search.signed.join(classes, ["high", "low", "n"], "left")
    return named.select("doc", "id", "n", "component", F.coalesce("least", "id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all columns: the one with the smallest doc_id.

    Of rows that carry this doc_id one stays, unless their texts are not linked; rows without a doc_id all stay.
    """
    rows = judged_rows(identified(docs).filter("id is not null"), words, percent)
    # Texts of one doc_id that are not linked have components of their own; each of these keeps a row.
    judged = rows.groupBy("id", "component").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("id") == F.col("component_id")).alias("kept"), F.collect_set("doc").alias("docs")
    )
    special = judged.filter("rows > 1 or not kept")
    special = special.select(F.explode("docs").alias("doc"), "id", (F.col("kept") & (F.col("doc") == F.array_min("docs"))).alias("kept"))
    special = special.select(F.struct("doc", "id", "kept").alias("judged")).hint("shuffle_hash")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), row_key().alias("doc"))
    met = whole.join(special, (whole["id"] == special["judged.id"]) & (whole["doc"] == special["judged.doc"]), "left")
    single = met.filter("judged is null").select("row.*")
    repeated = met.filter("judged.kept").dropDuplicates(["id", "doc"]).select("row.*")
    return single.unionByName(repeated)
