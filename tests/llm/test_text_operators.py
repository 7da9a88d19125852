"""Language, quality, mixing and token files."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import prose, words

from vecrec.llm import language, mixing, quality, token_file

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    found = SPLIT.findall(text or "")
    grams = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    inside = {p for i in range(len(found) - 4) if grams[tuple(found[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_measures_equal_brute_force(odd_docs, no_docs):
    texts = Counter((r.doc_id, r.text) for r in odd_docs.collect())
    got = Counter(tuple(r)[:6] for r in quality.quality_report(odd_docs).collect())
    assert got == Counter({(k, *measures(t)): n for (k, t), n in texts.items()})
    assert quality.quality_report(no_docs).count() == 0 == quality.filter_quality(no_docs).count()


def test_quality_filter_agrees_with_report_and_any_rule_order(odd_docs):
    kept = quality.quality_report(odd_docs).where("kept").count()
    assert quality.filter_quality(odd_docs).count() == kept
    assert quality.filter_quality(odd_docs).columns == odd_docs.columns
    rules = quality.base_rules(F.col("text")) + quality.rules(F.col("text"))
    assert odd_docs.where(quality.cascade(rules[::-1]).isNull()).count() == odd_docs.where(quality.cascade(rules).isNull()).count() == kept


def test_language_on_held_out_texts(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language.identify(docs).join(docs, "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() > 0.95 * found.count()
    got = language.identify(odd_docs)
    assert got.count() == odd_docs.count()
    assert {r.lang_pred for r in got.where("doc_id in (22, 23, 24, 25, 28)").collect()} == {"und"}
    assert got.where("score < 0 or score > 1 or held_out is null").count() == 0
    assert language.identify(no_docs).count() == 0


def test_a_repeated_key_teaches_each_text_its_own_language_only(spark):
    rows = [(1, "aaaa aaab aaba abaa", "aa"), (1, "zzzz zzzy zzyz zyzz", "zz"), (1, "mmmm mmmn mmnm", None)] + [(10 + k, "aaaa aaab" if k % 2 else "zzzz zzzy", "aa" if k % 2 else "zz") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs, "doc_id", "text", "lang")
    assert model.languages == ["aa", "zz"]
    assert model.predict("aaba abaa")[0] == "aa" and model.predict("zzyz zyzz")[0] == "zz"
    assert model.counts("aaba abaa")[0].tolist()[1] == 0 and model.counts("mmmm mmmn")[0].tolist() == [0, 0]


def test_language_filters_hold_all_they_learned_and_few_others():
    known = {f"l{k}": language.grams(np.arange(k * 5000, k * 5000 + 3000, dtype=np.uint64)).view(np.int64).tolist() for k in range(70)}
    model = language.Model.of(known)
    assert model.table.shape[1] == 2  # more than 64 languages
    for k in (0, 63, 69):
        h = np.array(known[f"l{k}"], np.int64).view(np.uint64)
        first, *rest = language.slots(h)
        met = model.table[first]
        for at in rest:
            met &= model.table[at]
        at = model.languages.index(f"l{k}")
        assert (met[:, at // 64] >> np.uint64(at % 64) & np.uint64(1)).all()
    assert model.false_rate.max() < 0.01


def test_token_files_round_trip_and_order(odd_docs, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_file.default_tokenizer())
    files = token_file.write_token_files(odd_docs, token_file.default_tokenizer(), shards=3)
    got = sorted(token_file.read_token_files(files).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r))
    start = 0
    for (key, text), r in zip(rows, got, strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_file.read_token_files(token_file.write_token_files(no_docs, token_file.default_tokenizer())).count() == 0


@pytest.mark.parametrize("ids", [[0], [7] * 9, [0, 2**32 - 1] * 5, list(range(5000, 9000)), [3] * 500 + [2**31], [49407, 1, 2] * 1000])
def test_packed_blocks(ids):
    ids = np.array(ids, np.uint32)
    for percentile in (0, 50, 95, 100):
        assert (token_file.unpack(token_file.pack(ids, percentile)) == ids).all()


def test_words_with_special_tokens_are_encoded_as_in_the_text():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(token_file.default_tokenizer()), token_file.Encoder(token_file.default_tokenizer())
    texts = ["a<|startoftext|>b <|endoftext|>c", "it's\x1cx   y", "Éá ΑΣ Σ 12 3.5", "<|startoftext|>", prose(3, 300), "x" * 3000, " a b\u0085c"]
    assert [x.tolist() for x in own(texts)] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_remembered_words_are_looked_up():
    """The memo is asked for the words of a text and never walked through; words of the older half move over."""

    class Memo(dict):
        def keys(self):
            raise AssertionError("walks through the memo")

    own = token_file.Encoder(token_file.default_tokenizer())
    want = [x.tolist() for x in own(["one two three", "two four"])]
    assert set(own.recent) == {"one", "two", "three", "four"}
    own.recent, own.older = Memo({w: own.recent[w] for w in ("one", "two")}), Memo({w: own.recent[w] for w in ("three",)})
    assert [x.tolist() for x in own(["one two three", "two four"])] == want
    assert set(own.recent) == {"one", "two", "three", "four"}


def test_mixture_meets_its_limits(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(k, " ".join(words(k, 5 + k % 7)), "abcde"[min(4, int(math.log2(k % 31 + 1)))]) for k in range(3000)], "doc_id bigint, text string, source string")
    size = {r.doc_id: (r.source, len(r.text.split())) for r in docs.collect()}
    total = Counter()
    for s, n in size.values():
        total[s] += n
    for most in (1.0, 1.7, 3.0):
        got = mixing.mix(docs, max_repeats=most).collect()
        assert len({r.doc_id for r in got}) == 3000  # nothing is dropped
        assert len(got) == len({(r.doc_id, r.mix_epoch) for r in got})
        read = Counter()
        for r in got:
            read[r.source] += size[r.doc_id][1]
        a = max(0.0, 1 - math.log(most) / math.log(max(total.values()) / min(total.values())))
        for s, n in total.items():
            assert read[s] / n == pytest.approx((max(total.values()) / n) ** (1 - a), abs=0.08)
    rows = spark.createDataFrame(list(total.items()), "source string, tokens bigint")
    target = 1.5
    a = mixing.exponent_for_entropy(rows, target)
    w = np.array([n**a for n in total.values()])
    assert -(w / w.sum() * np.log(w / w.sum())).sum() == pytest.approx(target, abs=1e-6)
    odd = mixing.mixed_documents(odd_docs)
    assert odd.columns == odd_docs.columns
    assert {(r.doc_id, r.text) for r in odd.collect()} == {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert mixing.mix(no_docs).count() == 0
