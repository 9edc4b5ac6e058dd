import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from latentfield.llm.token_counts import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["<|endoftext|>" * 300, "a" * 3000, " " * 2000 + "x" * 1000, "it's don't we'll " * 300, "1234567890" * 200, "é🙂日本 " * 500, "\n \n  \t" * 400, "x" * 999 + "<|endoftext|>" + " " * 700, ""]


def whole(c, text):
    return len(c.t.encode(text, add_special_tokens=False).ids)


def test_spliced_counts_equal_the_library(docs):
    for chunk, overlap in ((500, 16), (64, 4), (200, 2)):
        c = Counter(PATH, chunk_chars=chunk, overlap_chars=overlap)
        texts = HARD + [r.text or "" for r in docs.limit(60).collect()]
        assert c.counts(texts) == [whole(c, x) for x in texts]
        assert c.widened > 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n'ab1.<|>endoftxé", min_size=30, max_size=300))
def test_any_text_splices(text):
    c = test_any_text_splices.counter
    assert c.counts([text]) == [whole(c, text)]


test_any_text_splices.counter = Counter(PATH, chunk_chars=25, overlap_chars=3)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r'sab1.é\xa0\u2028\x1c日", max_size=40), min_size=1, max_size=4))
def test_units_add_up(texts):
    c = test_units_add_up.counter
    assert c.counts(texts) == [whole(c, x) for x in texts]


test_units_add_up.counter = Counter(PATH)


def test_units_equal_the_library_on_all_documents(docs):
    c = Counter(PATH)
    texts = HARD + [r.text or "" for r in docs.select("text").collect()]
    assert c.by_units and c.counts(texts) == c.encoded(texts) == c.counts(texts)
    c.cached = 1 << 40
    assert c.counts(texts[:9]) == c.encoded(texts[:9]) and c.cached < 1 << 20


def test_other_tokenizers_count_whole_texts():
    c = Counter(public_tokenizers.path("word_bpe_49k.json"))
    assert not c.by_units and c.counts(HARD) == [whole(c, x) for x in HARD]


def test_odd_rows(odd, none):
    c = Counter(PATH)
    want = sorted(((r.doc_id, len((r.text or "").encode()), whole(c, r.text or "")) for r in odd.collect()), key=repr)
    got = token_counts(odd, PATH).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got) and token_counts(none, PATH).count() == 0
