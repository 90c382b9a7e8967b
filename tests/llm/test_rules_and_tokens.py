"""The rule ledger, the tokenizer and the packing."""

import json
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blobsmith.llm import bpe, packing, quality_rules

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def repeated_plainly(words):
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert quality_rules.repeated_words(words) == repeated_plainly(words)


def test_measures():
    text = "One two\nOne two\n\n  \nthree four # $$ | end!"
    m = dict(zip(quality_rules.MEASURES, quality_rules.measure_text(text), strict=True))
    assert m["n_words"] == 9 and m["n_symbols"] == 4 and m["n_dup_lines"] == 1 and m["n_lines"] == 3 and m["n_shouts"] == 1
    assert m["word_chars"] == sum(len(w) for w in ["One", "two", "One", "two", "three four", "#", "$$", "|", "end!"])


def measured_plainly(text):
    """The measurements word by word and character by character."""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": repeated_plainly(words), "n_distinct_words": len(set(words)),
        "n_upper": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)), "n_digits": len(re.findall("[0-9]", text)), "n_shouts": text.count("!"),
    }


def test_every_measure_rule_and_verdict_equals_the_plain_way(spark):
    rng = random.Random(4)
    bits = ["word", "Ünï", "A", "LOUD", "1234", "#$%", "!", "\n", "\t", "\u3000", "x" * 40, "\x1c", "a b c d e f g h", "<|>", "\r\n"]
    texts = ["", " ", "word " * 19, "word " * 20, "word " * 200, "a " * 30, "x" * 60, "LOUD " * 30, "one two three\n" * 10, "1234 " * 30, "a! " * 30, *(rng.choice([" ", ""]).join(rng.choices(bits[: rng.randrange(2, len(bits) + 1)], k=rng.randrange(120))) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    failing = {rule: 0 for rule in quality_rules.RULES}
    for policy, chosen in quality_rules.POLICIES.items():
        for r in quality_rules.apply_policy(quality_rules.ledger(docs), policy).collect():
            want = measured_plainly(texts[r["doc_id"]])
            assert {m: r[m] for m in quality_rules.MEASURES} == want
            fails = [rule for rule, condition in quality_rules.RULES.items() if eval(condition, {}, want)]  # noqa: S307  the rules read the same in Python
            assert r["failure_bits"] == quality_rules.mask(*fails) and r["kept"] == (quality_rules.mask(*fails) & chosen == 0)
            for rule in fails:
                failing[rule] += 1
    assert min(failing.values()) > 0


def test_ledger(spark, odd_docs, no_docs):
    found = quality_rules.ledger(odd_docs)
    assert found.count() == odd_docs.count() and quality_rules.ledger(no_docs).count() == 0
    kept = {r["doc_id"] for r in quality_rules.apply_policy(found).where("kept").collect()}
    assert 7 in kept and 0 not in kept and 1 not in kept and 9 not in kept
    stayed = quality_rules.screen(odd_docs)
    assert stayed.columns == odd_docs.columns and stayed.where("doc_id = 7").count() == 1


def test_ablation_is_the_sum_over_single_judgements(spark):
    rules = list(quality_rules.RULES)
    bits = [random.Random(i).getrandbits(len(rules)) & random.Random(i + 99).getrandbits(len(rules)) for i in range(300)]
    rows = spark.createDataFrame([(b,) for b in bits], "failure_bits long")
    for policy, mask in quality_rules.POLICIES.items():
        got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablation(rows, policy).collect()}
        want = {r: (sum(b >> i & 1 for b in bits), sum(b & mask == 1 << i for b in bits)) for i, r in enumerate(rules) if mask >> i & 1}
        assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_encoder_equals_the_library(text):
    got = np.frombuffer(bpe.encoder(PATH).encode([text])[0], np.int32).tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


def test_both_forms_of_merging():
    rng, vocab = random.Random(3), bpe.encoder(PATH).vocab
    words = [bytes(rng.choice(b"abcdehtrn") for _ in range(rng.randint(1, 129))) for _ in range(300)]
    one = [bpe.merge_one(vocab, w) for w in words]
    assert [np.frombuffer(x, np.int32).tolist() for x in bpe.merge_many(vocab, words)] == one
    assert one == [e.ids for e in LIBRARY.encode_batch([w.decode() for w in words], add_special_tokens=False)]


def test_encode_and_decode(spark, odd_docs, no_docs):
    both = bpe.decode(bpe.encode(odd_docs, PATH), PATH).collect()
    assert len(both) == odd_docs.count() and bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    for doc_id, text in texts:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert any(r["doc_id"] == doc_id and r["ids"] == ids and r["text"] == LIBRARY.decode(ids, skip_special_tokens=False) for r in both)


def test_another_file_is_refused(tmp_path):
    other = tmp_path / "other.json"
    spec = json.loads(Path(PATH).read_text(encoding="utf-8"))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:1]
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="not a byte-level BPE"):
        bpe.Vocabulary(str(other))


@pytest.mark.parametrize("n", [0, 1, 7, 400, 20_000])
def test_plan_places_every_piece_once(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(256, np.maximum(1, rng.lognormal(4, 1.2, n).astype(int)))
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    slots = packing.plan(histogram, 256, 64)
    fill = Counter()
    for length, count in histogram.items():
        own = slots[slots["length"] == length].sort_values("first")
        assert own["first"].tolist() == np.cumsum([0, *own["count"]]).tolist()[:-1] and own["count"].sum() == count
        for s in own.itertuples():
            for k in range(s.count):
                fill[s.sequence + k // s.times] += length
    assert all(v <= 256 for v in fill.values()) and len(fill) == (max(fill) + 1 if fill else 0)
    if n >= 400:
        assert len(fill) <= 1.02 * -(-int(lengths.sum()) // 256)


def test_nnls():
    rng = np.random.default_rng(1)
    a, truth = rng.random((30, 12)), np.maximum(0, rng.normal(size=12))
    x = packing.nnls(a, a @ truth)
    assert np.allclose(x, truth, atol=1e-6)
    x = packing.nnls(a, rng.normal(size=30))
    assert (x >= 0).all()


def test_pack(spark, odd_docs, no_docs):
    found = packing.pack(odd_docs, PATH, 64).toPandas()
    assert packing.pack(no_docs, PATH, 64).count() == 0
    for _, group in found.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (group["offset"].to_numpy() == np.cumsum([0, *group["length"]])[:-1]).all() and group["length"].sum() <= 64
    for doc_id, text in {(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id <> 4").collect()}:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        own = found[found["doc_id"] == doc_id].sort_values("piece")
        want = [zlib.crc32(np.array(ids[i : i + 64], "<u4").tobytes()) for i in range(0, len(ids), 64)]
        assert own["ids_crc32"].tolist() == want and own["start"].tolist() == list(range(0, len(ids), 64))


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "some words " * (i % 9)) for i in range(40)], "doc_id long, text string")
    pieces = packing.cut(docs, PATH, 64)
    packed = packing.sequences(packing.pack(docs, PATH, 64), pieces)
    total = pieces.agg(F.sum("length")).first()[0]
    assert packed.agg(F.sum("length")).first()[0] == total and packed.where("length > 64").count() == 0
