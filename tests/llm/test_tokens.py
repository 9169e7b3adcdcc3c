import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from petalstream.llm import packing as P
from petalstream.llm import tokenize as T

pytestmark = pytest.mark.skipif(not Path(T.VOCABULARIES, "byte_bpe_50k.tiktoken").exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(Path(T.VOCABULARIES, "byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return T.encoder(T.load_ranks("byte_bpe_50k.tiktoken")), lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text_has_the_public_ids(both, text):
    assert both[0](text) == both[1](text)


@pytest.mark.parametrize("text", ["a" * 5000, "ก" * 700, "<|endoftext|>", " \n\n  x", "don't it'll", "漢字かな交じり文" * 40, "\x00\x1f", "1234567890" * 30])
def test_long_and_odd_texts(both, text):
    assert both[0](text) == both[1](text)


def test_merge_equals_the_plain_loop():
    ranks = T.load_ranks("byte_bpe_50k.tiktoken")

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(math.inf, 0))
            if best[0] == math.inf:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    r = random.Random(0)
    for _ in range(300):
        piece = bytes(r.choice(b"abething \xc3\xa1") for _ in range(r.randrange(1, 40)))
        assert T.merge(piece, ranks) == plain(piece)


def test_operator(spark, both):
    rows = [(1, "Bó hoa hồng", "x"), (1, "Bó hoa hồng", "x"), (2, None, "y"), (3, "", None), (4, "a b " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in T.token_ids(df, "text", "doc_id").collect())
    assert got == sorted((i, tuple(both[1](t)) if t else ()) for i, t, _ in rows)
    assert sorted(r.n_tokens for r in T.token_counts(df, "text", "doc_id").collect()) == sorted(len(both[1](t)) if t else 0 for _, t, _ in rows)
    assert T.token_ids(df.limit(0), "text", "doc_id").count() == 0


def check(rows, sizes, capacity):
    fill, pieces = Counter(), defaultdict(list)
    for r in rows:
        fill[r.container] += r.n_tokens
        pieces[r.doc_id].append((r.start, r.n_tokens))
    assert all(f <= capacity for f in fill.values())
    for k, n in sizes.items():
        if not n:
            assert k not in pieces
            continue
        own = sorted(pieces[k])
        assert sum(x for _, x in own) == n and [s for s, _ in own] == [i * capacity for i in range(len(own))] and len(own) == -(-n // capacity)
    return fill


def test_packing_is_whole_and_tight(spark):
    r = random.Random(1)
    sizes = {i: int(r.paretovariate(1.1) * 40) if i % 17 else 0 for i in range(4000)}
    sizes[0], sizes[1], sizes[2] = 9000, 2048, 4096
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()], "doc_id long, n_tokens long, container string").repartition(9)
    fill = check(P.pack(df.drop("container"), "doc_id", "n_tokens").collect(), sizes, 2048)
    assert len(fill) <= math.ceil(sum(sizes.values()) / 2048 * 1.005) + 1
    again = check(P.pack(df, "doc_id", "n_tokens", at_once=200).collect(), sizes, 2048)
    assert sum(again.values()) == sum(sizes.values())
    assert len(again) <= math.ceil(sum(sizes.values()) / 2048 * 1.02) + 1  # many rounds of small tasks do nearly as well
    f = P.fills(P.pack(df, "doc_id", "n_tokens"), "n_tokens").collect()
    assert len(f) == len(fill) and all(r.fill + r.room == 2048 and r.room >= 0 for r in f) and sum(r.fill for r in f) == sum(sizes.values())


def test_items_that_fit_with_none_end_the_rounds(spark):
    df = spark.createDataFrame([(i, 1100 + i % 800) for i in range(900)], "doc_id long, n_tokens long").repartition(6)
    rows = P.pack(df, "doc_id", "n_tokens", at_once=50).collect()
    assert len({r.container for r in rows}) == len(rows) == 900
    # small ones that lie in a partition of their own are mixed with them first
    small = spark.createDataFrame([(1000 + i, 140) for i in range(900)], "doc_id long, n_tokens long").coalesce(1)
    rows = P.pack(df.union(small), "doc_id", "n_tokens", at_once=100_000).collect()
    assert len({r.container for r in rows}) == 900


def test_packing_edges(spark):
    schema = "doc_id long, n_tokens long"
    assert P.pack(spark.createDataFrame([], schema), "doc_id", "n_tokens").count() == 0
    assert P.pack(spark.createDataFrame([(1, None), (2, 0)], schema), "doc_id", "n_tokens").count() == 0
    one = P.pack(spark.createDataFrame([(1, 7)], schema), "doc_id", "n_tokens", capacity=8).collect()
    assert [(r.doc_id, r.piece, r.n_tokens, r.start) for r in one] == [(1, 0, 7, 0)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_holds_everything_once(sizes):
    bins = P.best_fit(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 20 for b in bins)
