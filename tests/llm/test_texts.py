"""Operators on texts: encoding, packing, truncation."""

import random

import numpy as np
import pytest
import tiktoken

from lacuna.llm import bpe, packing, truncation
from lacuna.runtime import Scratch


@pytest.fixture(scope="module")
def pair():
    own = bpe.ByteBPE()
    return own, tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=own.ranks, special_tokens={})


def test_encoding_equals_public_library(pair):
    own, ref = pair
    rng = random.Random(0)
    texts = ["", " ", "\n\n", "a", "<|endoftext|> <|startoftext|>", "I'll we've", "été 東京 👍🏽", "x" * 3000, " " * 500, "\x00\x01", "�"]
    texts += ["".join(rng.choice("aeion trs.,'\né東👍") for _ in range(rng.randrange(1, 400))) for _ in range(500)]
    for t in texts:
        assert own.encode(t) == ref.encode_ordinary(t)


def test_very_long_piece_is_a_round_trip(pair):
    own, _ = pair
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(300_000))
    words = {i: b for b, i in own.ranks.items()}
    assert b"".join(words[i] for i in own.encode(text)).decode() == text


def test_rank_queue_gives_lowest_rank_first():
    q = bpe.RankQueue()
    for rank, at in [(70_000, 1), (5, 9), (5, 2), (64, 3), (4096, 4)]:
        q.push(rank, at)
    order = []
    while (r := q.lowest()) >= 0:
        order.append((r, q.take(r)))
    assert order == [(5, [2, 9]), (64, [3]), (4096, [4]), (70_000, [1])]


def test_columns_of_ids_and_counts(spark, pair):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_column(df, "doc_id", "text").collect()}
    assert got == {1: pair[1].encode_ordinary("Hello world"), 2: [], 3: [], 4: pair[1].encode_ordinary("Hello world")}
    assert {r["doc_id"]: r["tokens"] for r in bpe.count_tokens(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert bpe.encode_column(df.where("false"), "doc_id", "text").count() == 0


def test_best_two_fit_is_valid_and_tight():
    rng = np.random.default_rng(0)
    for sizes in ([], [512], [512, 1, 1], sorted(rng.integers(1, 513, 2000).tolist(), reverse=True), sorted((rng.lognormal(4, 1, 3000).astype(int) % 512 + 1).tolist(), reverse=True)):
        bins = packing.best_two_fit(sizes, 512)
        fill = np.bincount(bins, sizes) if sizes else np.zeros(0)
        assert len(bins) == len(sizes) and (fill <= 512).all()
        if len(sizes) > 100:
            first_fit = []
            for s in sizes:
                i = next((i for i, f in enumerate(first_fit) if f + s <= 512), None)
                if i is None:
                    first_fit.append(s)
                else:
                    first_fit[i] += s
            assert len(fill) <= len(first_fit)


def test_two_items_replace_the_smallest():
    # greedy takes 60 + 30, then 30 gives way to 25 + 15
    bins = packing.best_two_fit([60, 30, 25, 15], 100)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_pack_keeps_every_token(spark):
    rows = [(i, n) for i, n in enumerate([10, 0, None, 1300, 512, 511, 1, 1, 1, 40, 40, 700, 5])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, tokens long, container_id string")
    out = packing.pack(df, "doc_id", "tokens", {"short": 512, "long": 2048}, Scratch(spark)).collect()
    for target, cap in (("short", 512), ("long", 2048)):
        own = [r for r in out if r["target_name"] == target]
        fill = {}
        for r in own:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
        assert max(fill.values()) <= cap
        for i, n in rows:
            parts = sorted((r["piece"], r["start_token"], r["tokens"]) for r in own if r["doc_id"] == i)
            assert sum(p[2] for p in parts) == (n or 0)
            assert len(parts) == max(1, -(-(n or 0) // cap)) and [p[1] for p in parts] == [k * cap for k in range(len(parts))]
    assert packing.pack(df.where("false"), "doc_id", "tokens", {"short": 512}, Scratch(spark)).count() == 0
    assert packing.pack(df, "doc_id", "tokens", {}, Scratch(spark)).count() == 0


def test_shards_are_packed_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    rng = np.random.default_rng(2)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 400, 1000))]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), "doc_id", "tokens", {"short": 512}, Scratch(spark)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(1000))
    assert sum(n for _, n in rows) / (512 * len({r["container_id"] for r in out})) > 0.97


def test_containers_do_not_depend_on_the_cores(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 60)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 400, 400))], "doc_id long, tokens long")
    packed = [sorted((r["doc_id"], r["container_id"]) for r in packing.pack(df.repartition(n), "doc_id", "tokens", {"short": 512}, Scratch(spark)).collect()) for n in (1, 5)]
    assert packed[0] == packed[1]


SENTENCES = ["The camera was moved behind the old boiler.", "Nobody knows why the server stays silent.", "We compared the files and the report looks fine.", "My colleague swears by the green cable."]


def corpus():
    rng = random.Random(4)
    return [(i, "web", " ".join(rng.choice(SENTENCES) for _ in range(rng.randrange(2, 6)))) for i in range(300)]


CASES = [
    ("The camera was moved behind the old boi", True), ("The camera was moved behind the", True), ("The camera was moved behind the old boiler", False), ("It is done. oh well…", False),
    ("Nobody knows why the ser (more)", True), ("Nobody knows why the ser… »", True), ("See </sp", True), ("See <br>", False), ("See it &nbs", True), ("See it &nbsp;", False), ("We compared the fil�", True),
    ("My colleague swears by the green cable.\n-- \nsomebody", False), ("All good.\n> quoted text that is cut in the mid…", False), ("All good.\n> Nobody knows why the serv", True), ("All good.\n> Nobody knows why the server stays silent", False), ("", False), (None, False), ("   \n", False), ("http", True), ("We compared the files and", True),
]


@pytest.mark.parametrize("text, cut", CASES)
def test_ends(text, cut):
    """The rules alone, with the counts of a small corpus."""
    reader = truncation.Reader()
    docs = [t for _, _, t in corpus()] + [text, "Look at <span>this</span> &nbsp;now."]
    state, keys = truncation.candidate(reader, text)
    tally, words = {}, truncation.Counter()
    for t in docs:
        truncation.count_text(reader, t, tally, set(keys).__contains__, words)
    for w, c in words.items():
        for h in truncation.beginnings(w):
            if h in keys:
                tally.setdefault(h, [0, 0])[0] += c
    assert truncation.decide(state, [tuple(tally.get(k, (0, 0))) for k in keys], False, False) is cut


@pytest.mark.parametrize(
    "text, state, stack",
    [
        ('He said "this is a long quotation that never ends.', "held", ['"']), ("<b>This is bold and never closed.", "held", ["b"]), ('{"a": [1, 2, {"b": "c."', "cut", ["{", "[", "{"]),
        ('A "quoted" word (and more) is [b]fine[/b].', "whole", []), ('One "open quote.\n\nNext paragraph ends.', "whole", []), ("[quote]One.\n\nTwo.", "held", ["quote"]), ("5 < 6 is true.", "whole", []),
        ('See <a href="http://e.org/' + "y" * 5000, "cut", None), ('See <a title="' + "many words " * 500, "cut", None), ("See [url=http://e.or", "cut", None), ("A link %E2%82", "cut", None), ("A link %E2%82%AC.", "whole", []),
        ("He wrote \\u20", "cut", None), ("See &#82", "cut", None), ("See <blockq", "part", None), ("See [quo", "part", None), ("My guess (only a guess)", "closed", []), ("<b>" * 20_000 + "</i>" * 20_000 + " x.", "held", ["b"] * 20_000),
    ],
)
def test_stack_reads_the_whole_text(text, state, stack):
    reader = truncation.Reader()
    assert truncation.candidate(reader, text)[0] == state
    assert stack is None or reader.stack(text) == stack


def test_held_text_is_cut_only_at_its_limit():
    for state in ("held", "closed"):
        assert truncation.decide(state, [], True, False) and not truncation.decide(state, [], False, True)


def test_truncated_equals_plain_rules(spark):
    rows = corpus() + [(999, "web", "Look at <span>this</span> now.")] + [(1000 + i, None if i % 2 else "web", t) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, source string, text string, cut int").repartition(3)
    out = {r["doc_id"]: r["cut"] for r in truncation.truncated(df, "doc_id", Scratch(spark)).collect()}
    assert len(out) == len(rows)
    assert {1000 + i: cut for i, (_, cut) in enumerate(CASES)} == {k: v for k, v in out.items() if k >= 1000}
    assert not any(v for k, v in out.items() if k < 1000)


def test_field_limit_of_a_source(spark):
    texts = [(" ".join(SENTENCES) * 3)[:100] for _ in range(40)]
    rows = corpus() + [(2000 + i, "short", t) for i, t in enumerate(texts)]
    out = truncation.truncated(spark.createDataFrame(rows, "doc_id long, source string, text string"), "doc_id", Scratch(spark))
    rates = {r["source"]: (r["posts"], r["cut"]) for r in truncation.rates(out).collect()}
    assert rates == {"web": (300, 0), "short": (40, 40)}


def test_truncated_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert truncation.truncated(df, "doc_id", Scratch(spark)).count() == 0
