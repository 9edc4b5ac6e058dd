import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from latentfield.llm.piece_codec import LONG, Codec, round_trip, with_pieces, with_text

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["a  b\n\n c\t日本語 🙂 x", "   ", "\n", "a" * 100 + " " + "b" * 3000, " x", "", "Hello, World! naïve café"]
plain, varied = Codec(PATH, dropout=0.0), Codec(PATH, dropout=0.3)


def ids(data):
    return np.frombuffer(data, "<i4").tolist()


def test_without_dropout_as_the_library(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = TEXTS + [r.text or "" for r in docs.collect()]
    assert [ids(x) for x in plain.encode(texts, [None] * len(texts))] == sp.encode(texts)


def test_agenda_and_arrays_agree(docs):
    words = sorted({w for r in docs.limit(60).collect() for w in varied.words.findall(r.text or "") if len(w) <= LONG})
    for v in (0, 5):
        assert [ids(x) for x in varied.merge_all(words, [v] * len(words))] == [varied.agenda(w, v) for w in words]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)), st.integers(0, 99))
def test_any_text_comes_back(text, key):
    assert varied.decode(ids(varied.encode([text], [key])[0])) == text


def test_literal_space_mark_comes_back():
    assert varied.decode(ids(varied.encode(["a▁b ▁"], [1])[0])) == "a▁b ▁"


def test_dropout_varies_by_key_and_repeats_by_seed(docs):
    text = [max((r.text or "" for r in docs.collect()), key=len)]
    one, two = varied.encode(text, [1])[0], varied.encode(text, [2])[0]
    assert one != two and len(one) > len(plain.encode(text, [1])[0])
    assert one == Codec(PATH, dropout=0.3).encode(text, [1])[0] != Codec(PATH, dropout=0.3, seed=2).encode(text, [1])[0]


def test_odd_rows(odd, none):
    got = round_trip(odd, PATH).collect()
    assert len(got) == odd.count() and all(r.lossless for r in got)
    assert {r.doc_id: r.n_pieces for r in got if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert len({r.ids_crc for r in got if r.doc_id == 7}) == 1
    assert round_trip(none, PATH).count() == 0


def test_encoding_keeps_columns_and_decodes(odd):
    encoded = with_pieces(odd, PATH)
    assert set(encoded.columns) == set(odd.columns) - {"text"} | {"piece_ids"}
    back = with_text(encoded, PATH).select("doc_id", "text").collect()
    assert sorted(map(repr, back)) == sorted(map(repr, odd.select("doc_id", "text").collect()))


def test_each_occurrence_is_segmented_by_itself():
    text = "internationalization considerations " * 40
    got = varied.encode([text] * 400, list(range(400)))
    assert len(set(got)) == 400  # 8 before
    one = Codec(PATH, dropout=0.3).encode(["internationalization " * 400], [1])[0]
    words = varied.encode(["internationalization"] * 400, list(range(400)))
    assert len(set(words)) > 100 and len(one) > 400


def test_cached_nodes_give_what_the_agenda_gives(docs):
    texts = [r.text or "" for r in docs.limit(40).collect()]
    for codec in (Codec(PATH, dropout=0.1), Codec(PATH, dropout=0.6)):
        words = [w for x in texts for w in codec.words.findall(" " + x) if len(w) <= LONG][:6000]
        keys = np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for _ in range(2):
            assert [ids(x) for x in codec.occurrences(words, keys)] == [codec.agenda(w, int(k)) for w, k in zip(words, keys)]
