import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marginalia.llm.packing import Plan, dominating, pack, plan_packing
from marginalia.llm.tokens import Encoder, cut_documents
from tests.llm.rows import awkward, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(sizes, capacity):
    """Least number of sequences, by search."""
    best = len(sizes)

    def place(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        size = rest[0]
        for i in {r: i for i, r in enumerate(rooms) if r >= size}.values():
            place(rest[1:], rooms[:i] + [rooms[i] - size] + rooms[i + 1 :])
        place(rest[1:], [*rooms, capacity - size])

    place(sorted(sizes, reverse=True), [])
    return best


def check(plan, sizes, capacity):
    """Every piece has one place, and places neither overlap nor leave gaps."""
    content = {}
    for length, first, count, per, sequence, offset in plan.runs:
        for i in range(count):
            content.setdefault(sequence + i // per, []).append((offset + i % per * length, length))
    assert len(content) == plan.sequences
    for parts in content.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    got = {}
    for parts in content.values():
        for _, length in parts:
            got[length] = got.get(length, 0) + 1
    assert got == {k: v for k, v in sizes.items() if v}


def test_plan_is_valid_and_near_the_fewest():
    rng = random.Random(2)
    worse = 0
    for _ in range(250):
        capacity = rng.randint(5, 40)
        pieces = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        sizes = {s: pieces.count(s) for s in set(pieces)}
        plan = plan_packing(sizes, capacity)
        check(plan, sizes, capacity)
        worse += plan.sequences - (fewest(pieces, capacity) if pieces else 0)
    assert worse <= 3


def test_dominating_sets_cost_nothing():
    """Fixing the set a rule names leaves an instance that needs one sequence less."""
    rng = random.Random(8)
    seen = 0
    for _ in range(400):
        capacity = rng.randint(6, 30)
        pieces = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        counts = np.bincount(pieces, minlength=capacity + 1)
        for j in set(pieces):
            members = dominating(j, counts, capacity)
            if members:
                seen += len(members) > 1
                rest = list(pieces)
                for m in members:
                    rest.remove(m)
                assert sum(members) <= capacity
                assert (fewest(rest, capacity) if rest else 0) + 1 == fewest(pieces, capacity), (pieces, capacity, members)
    assert seen > 100


def test_large_instance_is_near_its_bound():
    rng = np.random.default_rng(1)
    sizes = np.bincount(rng.integers(1, 4097, 200_000), minlength=4097)
    plan = plan_packing({i: int(n) for i, n in enumerate(sizes) if n}, 4096)
    assert isinstance(plan, Plan) and plan.fixed > 0
    assert plan.sequences <= 1.002 * -(-int((sizes * np.arange(4097)).sum()) // 4096)


def test_pack_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 20)) for i in range(300)] + [(7, 5), (7, 5), (8, None), (9, 0), (10, 21), (None, 4)]
    pieces = spark.createDataFrame([(d, n, "p", 3) for d, n in rows], "doc_id long, length long, part string, sequence_id int")
    packed = pack(pieces.repartition(4), 20).collect()
    assert len(packed) == len(rows)
    assert [r["length"] for r in packed if r["sequence_id"] is None].__len__() == 3
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed if r["sequence_id"] is not None)
    for _, group in itertools.groupby(places, key=lambda p: p[0]):
        end = 0
        for _, offset, length in group:
            assert offset == end
            end += length
        assert end <= 20
    total = sum(p[2] for p in places)
    assert len({p[0] for p in places}) <= -(-total // 20) + 3
    assert pack(pieces.limit(0), 20).count() == 0


TEXTS = [
    "", " ", "Hello, World! it's we're 3rd x²½ ½½ — naïve Ärger ÇA\tça\n\nend", "İstanbul ŞEKER", "école ẞ ﬁ Ⅷ", "a\x1cb\x85c d",
    "<|endoftext|> <|startoftext|>x <| <p>", "''''s 'S 'll'd", "漢字 かな 한국어 🙂👍🏽", "x" * 5000, "don't'ven't " * 40, " 　 z\x00", "µª º×÷ ÿŸ",
]


def test_ids_equal_the_tokenizers_own():
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    alphabet = "aAbeé'ñ 1².,\t!ßĀį'sx"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    encoder = Encoder(PATH)
    assert encoder.short
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    again = encoder.encode(texts)
    assert again == Encoder(PATH).encode(texts)


@pytest.mark.parametrize("capacity", [8, 4096])
def test_pieces(spark, capacity):
    whole = Tokenizer.from_file(PATH)
    rows = awkward() + list(enumerate(TEXTS, 100))
    got = cut_documents(documents(spark, rows), PATH, capacity, 1, ids=True).collect()
    expected = []
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            crc = zlib.crc32(np.array(part, "<u4").tobytes())
            expected.append((str(doc_id), piece, start, len(part), crc, part))
    fields = ["piece", "start", "length", "ids_crc32", "ids"]
    assert sorted((str(r["doc_id"]), *[r[f] for f in fields]) for r in got) == sorted(expected)
