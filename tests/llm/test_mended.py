"""Texts made to collide, corpora of mostly bad documents, equal rules, and long texts of candidates."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import decontaminate, jaccard, records, secrets, urls
from waymark.llm.em import fit_votes
from waymark.llm.hashing import range_keys, word_hashes
from waymark.llm.queries import vocabulary
from waymark.plans.scratch import materialize


def twins(doublings):
    """Two words whose polynomials agree modulo 2**64 for any odd base."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_twins_get_their_own_ids(spark):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encode = records.byte_bpe(path)
    ids = lambda t: np.array([*library.encode(t, add_special_tokens=False).ids, 0], np.uint16).tobytes()
    for doublings in (9, 10, 11):
        a, b = twins(doublings)
        for texts in ([a, b], [b], [a], [f"x {a}. {b}.", f"{b}, {a}"], [b + "!", a + "!"]):
            assert encode(texts) == [ids(t) for t in texts]
    a, b = twins(10)
    raw = np.frombuffer((a + b).encode(), np.uint8)
    keys = range_keys(raw, np.array([0, 1024]), np.array([1024, 1024]))
    assert keys[0] == keys[1]  # so the bytes were compared


def test_twins_are_different_words(spark):
    pairs = [twins(k) for k in (10, 11)]
    hashes, _ = word_hashes([w for p in pairs for w in p])
    assert len(set(hashes.tolist())) == 4
    for a, b in pairs:
        docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")
        assert sorted(tuple(r) for r in jaccard.jaccard_components(docs).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
        item = " ".join([a] * 3 + ["one", "two", "three", "four", "five"])
        table = spark.createDataFrame([(1, item), (2, item.replace(a, b))], "item_id long, text string")
        text = spark.createDataFrame([(9, " ".join([b] * 3 + ["one", "two", "three", "four", "five"]))], "doc_id long, text string")
        full = {r.item_id for r in decontaminate.contaminated(text, table).collect() if r.words_covered == r.item_words}
        assert full == {2}


def test_short_words_never_collide():
    rng = random.Random(2)
    texts = list({"".join(rng.choice("abAB01é") for _ in range(rng.randrange(1, 8))) for _ in range(20_000)})
    hashes, offsets = word_hashes(texts)
    assert (np.diff(offsets) == 1).all()
    by = {}
    for t, h in zip(texts, hashes.tolist(), strict=True):
        by.setdefault(h, set()).add("".join(c.lower() if c.isascii() else c for c in t))
    assert all(len(v) == 1 for v in by.values())


@pytest.mark.parametrize("good_share", [.05, .2, .5, .8])
def test_vote_model_finds_the_share(good_share):
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < good_share
    said = np.where(rng.random((20_000, 8)) < .15, "0", np.where(rng.random((20_000, 8)) < np.where(good, .9, .25)[:, None], "+", "-"))
    votes = ["".join(v) for v in said]
    model = fit_votes(Counter(votes), 8)
    kept = np.array([model.log_odds(v) >= 0 for v in votes])
    assert kept[~good].mean() <= .15
    assert kept[good].mean() >= .85
    assert all(abs(g - .9) < .06 and abs(b - .75) < .06 for g, b in model.accuracy)


def test_rules_of_one_length(spark, monkeypatch):
    rules = (("a.com/f", "block"), ("com/frx", "allow"), ("net/x/", "allow"), ("net/x/", "block"))
    pages = spark.createDataFrame([(1, "http://a.com/frx/1", None), (2, "http://q.net/x/1", None)], "page_id long, url string, html string")
    inline = sorted(tuple(r)[:5] for r in urls.judge_urls(pages, rules).collect())
    monkeypatch.setattr(urls, "MOST_RULES", 0)
    joined = sorted(tuple(r)[:5] for r in urls.judge_urls(pages, rules).collect())
    listed = spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "rule string, verdict string, place long").repartition(3)
    table = sorted(tuple(r)[:5] for r in urls.judge_urls(pages, listed).collect())
    assert inline == joined == table and [r[3:] for r in inline] == [("a.com/f", "block"), ("net/x/", "allow")]


def test_secret_scan_of_a_long_log():
    enc = secrets.encoding(vocabulary("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    text = "\n".join(f'token = "{rng.getrandbits(80):020x}" /usr/share/some-path/{i}/module_name.file-{i}.txt 123e4567-e89b-12d3-a456-426614174000' for i in range(20_000))
    began = time.perf_counter()
    base, _ = secrets.scan(text, enc)
    assert len(base) == 20_000 and time.perf_counter() - began < 60


def test_jaccard_crowds_tell_of_shared_signatures():
    """Part 0 tells which signatures of a slice are shared; no row but repeats is lost, and crowds leave two rows there."""
    rng = np.random.default_rng(12)
    for size in (0, 1, 5, 400):
        sig, node = rng.integers(0, 40, size).astype(np.uint64), rng.integers(-6, 6, size)
        s, v, part = jaccard.crowds(sig, node)
        assert set(zip(s.tolist(), v.tolist(), strict=True)) == set(zip(sig.tolist(), node.tolist(), strict=True))
        assert len(s) == len(v) == len(part) and part.max(initial=0) <= jaccard.SPREAD
        for x in set(sig.tolist()):
            nodes, here = set(node[sig == x].tolist()), set(v[(s == x) & (part == 0)].tolist())
            assert {min(nodes), max(nodes)} <= here
            assert len(here) == 2 or (s == x).sum() == len(here) < jaccard.CROWD or len(nodes) == 1


def test_jaccard_shared_shingles_are_counted_over_slices(spark):
    """``_possible`` in slices of one, a few and all texts against counting by hand."""
    rng = np.random.default_rng(13)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, 12)) for _ in range(40)] + ["all words of this one are its own"]
    want_sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    keys = [jaccard.set_key(s) for s in jaccard._sets(pa.array(texts), 5)]
    by_node = dict(zip(keys, want_sets, strict=True))
    want = {k: len({g for g in s if any(g in o for q, o in by_node.items() if q != k)}) for k, s in by_node.items()}
    for parts in (1, 7, 41):
        docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(parts)
        rows = [(k, i) for i, k in enumerate(keys) if keys.index(k) == i]
        nodes = spark.createDataFrame(rows, "node long, key long").join(docs.select("key", F.xxhash64("text").alias("row")), "key").select("node", "key", "row")
        got = {r["node"]: r["shared"] for r in jaccard._possible(docs, nodes, 5).collect()}
        assert got == {k: n for k, n in want.items() if n}


def test_idle_workers_forget_encoders(monkeypatch):
    """Workers outlive the step: what an encoder remembers (some 300 MB a worker) stayed for all later steps."""
    monkeypatch.setattr(records, "IDLE_S", 0.5, raising=False)
    records._ENCODERS.clear()
    encode = records.byte_bpe(vocabulary("byte_bpe_50k.json"))
    before = encode(["a word and a word", ""])
    assert len(records._ENCODERS) == 1
    end = time.monotonic() + 10
    while records._ENCODERS and time.monotonic() < end:
        time.sleep(0.1)
    assert not records._ENCODERS
    assert encode(["a word and a word", ""]) == before


def test_workers_get_as_many_rows_as_are_worked_on(spark):
    """Ten times as many texts lay in memory at once; the setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    made = materialize(spark.range(5000, numPartitions=1).mapInArrow(sizes, "n long"))
    assert [r.n for r in made.collect()] == [1000] * 5 and spark.conf.get(name) == before


def test_jaccard_joins_stars_of_slices(spark, monkeypatch):
    """Chains, hubs, loops and repeats, in slices that cut them up."""
    monkeypatch.setattr(jaccard, "HELD", 40)
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(-5, -5), (-7, 2**62), (2**62, -2**62), (1000, 1001)]
    low = {x: x for e in edges for x in e}
    while (worse := [(a, b) for a, b in edges if low[a] != low[b]]):
        for a, b in worse:
            low[a] = low[b] = min(low[a], low[b])
    rows = [edges[i][::1 if i % 2 else -1] for i in rng.permutation(len(edges))]
    got = jaccard._joined(spark.createDataFrame(rows, "a long, b long").repartition(5)).collect()
    assert len(got) == len(set(got)) and dict(map(tuple, got)) == {x: y for x, y in low.items() if x != y}
    assert jaccard._joined(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_large_buckets_take_few_stages(spark):
    """A bucket that stays open to the last comparison: each stage costs a task a partition, whatever the data."""
    rng, texts = np.random.default_rng(9), []
    for _ in range(150):
        w = [f"c{i}" for i in range(60)]
        for i in rng.integers(0, 60, 3):
            w[i] = "the"
        texts.append(" ".join(w))
    df, sc = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.sparkContext
    sc.setJobGroup("jaccard-stages", "")
    try:
        assert jaccard.jaccard_components(df).count() == 150
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("jaccard-stages")]
        ran = sum(bool((s := sc.statusTracker().getStageInfo(i)) and s.numCompletedTasks) for j in jobs for i in j.stageIds)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert ran <= 190  # 229 when every phase joined its own links, 157 since
