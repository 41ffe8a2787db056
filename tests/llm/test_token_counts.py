from tokenizers import Tokenizer

from lumenspan.llm import packing, token_counts

TEXTS = [None, "", "one", "one", "two words.", "a longer text of some more words, in a row!", "long " * 30_000, "  \n "]


def lengths_of(texts):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_histogram_and_totals_equal_brute_force(spark, docs):
    lengths = lengths_of(TEXTS)
    sums = token_counts.with_sums(token_counts.histogram(docs(*enumerate(TEXTS), extra=True))).cache()
    rows = {r["length"]: r for r in sums.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == {k: lengths.count(k) for k in lengths}
    limits = sorted({0, 1, 2, 3, 5, 7, 100, 29_999, 30_000, 10**6, *lengths})
    for r in token_counts.totals_at(sums, limits).collect():
        assert r["n_longer"] == sum(x > r["limit"] for x in lengths)
        assert r["tokens_kept"] == sum(min(x, r["limit"]) for x in lengths)
        assert r["tokens_lost"] == sum(lengths) - r["tokens_kept"]
    for k, r in rows.items():
        assert (r["n_longer"], r["tokens_kept"]) == (sum(x > k for x in lengths), sum(min(x, k) for x in lengths))
        assert r["share"] == sum(x <= k for x in lengths) / len(lengths)


def test_quantiles(spark, docs):
    lengths = sorted(lengths_of(TEXTS))
    sums = token_counts.with_sums(token_counts.histogram(docs(*enumerate(TEXTS))))
    for r in token_counts.quantiles(sums, [0.1, 0.5, 0.75, 1.0]).collect():
        assert r["length"] == next(x for i, x in enumerate(lengths, 1) if i >= r["share"] * len(lengths) and lengths.count(x) + lengths.index(x) >= r["share"] * len(lengths))


def test_empty_table(spark, docs):
    assert token_counts.with_sums(token_counts.histogram(docs((1, "a")).limit(0))).count() == 0
