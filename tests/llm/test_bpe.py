"""BPE against the tokenizers library, and against merging by rank."""

import json
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe, queries

from .fixtures import clashing, documents, table_of

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


def ids_of(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def same(codec, library, text):
    raw = codec.encode(text)
    ids = library.encode(text, add_special_tokens=False).ids
    return ids_of(raw) == ids and codec.decode(raw) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ σας", "İstanbul é ﬁ", "a" * 5000, "ha" * 3000, "!" * 3000, "don't WE'LL I'M x's", "日本語 ñandú \u0085²½x", "a\x1cb\x1fc\x00d"])
def test_hard_texts(codec, library, text):
    assert same(codec, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aabcdeinrst'.,!<>|/_- \n019")), st.characters(max_codepoint=0x2FF)), max_size=60))
def test_random_texts(codec, library, text):
    assert same(codec, library, text)


def test_every_code_point(codec, library):
    """Alone, between letters and twice in a row, so that its class, its case and its composition show."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b 1{chr(c)}{chr(c)} e{chr(c)}\u0301" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    wrong = [i for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)) if ids_of(codec.encode(texts[i])) != e.ids]
    assert not wrong


def test_marks_and_compositions(codec, library):
    points = [chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    texts = [t for c in points if unicodedata.combining(c) for t in (f"a{c}\u0334\u0301", f"e\u0316{c}\u0327", f"{c}{c}o\u0302\u0301", f"\u05d0{c}\u05b7")]
    texts += [unicodedata.normalize("NFD", c) + unicodedata.normalize("NFD", c)[-1:] for c in points if unicodedata.normalize("NFD", c) != c]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if ids_of(codec.encode(t)) != e.ids]
    assert not wrong


@pytest.mark.parametrize("part", ["normalizer", "pre_tokenizer", "decoder", "model"])
def test_files_of_other_tokenizers_are_refused(tmp_path, part):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec[part] = {**spec["model"], "byte_fallback": True} if part == "model" else {"type": "Lowercase" if part == "normalizer" else "ByteLevel"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match=part):
        bpe.load_vocabulary(str(tmp_path / "other.json"))


def test_ids_are_decoded_in_any_order(codec, library):
    r = random.Random(4)
    lists = [[r.randrange(49_408) for _ in range(n)] for n in (0, 1, 7, 300)]
    raw = [b"".join(i.to_bytes(4, "little") for i in x) for x in lists]
    assert codec.decode_many(raw).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_random_words_equal_merging_by_rank(codec):
    e, r = codec.words.encoder, random.Random(3)

    def merged(units):
        ids = [bpe_id[u] for u in units]
        while True:
            best = min(((e.rank.get((a, b), bpe.NEVER), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))), default=(bpe.NEVER, 0))
            if best[0] == bpe.NEVER:
                return ids
            i = best[1]
            ids[i : i + 2] = [made[ids[i], ids[i + 1]]]

    v = bpe.load_vocabulary(PATH)
    bpe_id = {chr(b): v.inner[b] for b in range(256)} | {chr(b + 256): v.final[b] for b in range(256)}
    made = {(a, b): c for a, b, c in v.merges}
    for _ in range(1500):
        w = "".join(r.choice("aabcdehilnorstu") for _ in range(r.randint(1, 24)))
        units = w[:-1] + chr(ord(w[-1]) + 256)
        assert e.encode(units) == merged(units)


def test_the_library_agrees_on_the_test_tables(spark, sf_dir, codec, library):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert all(same(codec, library, t or "") for t in texts)


def test_operator(spark, library):
    rows = documents()
    got = bpe.encode_texts(clashing(table_of(spark, rows)), bpe.load_vocabulary(PATH)).collect()
    want = sorted(repr((r[0], library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted(repr((r["doc_id"], ids_of(bytes(r["ids"])))) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)
    assert bpe.encode_texts(table_of(spark, rows).limit(0), bpe.load_vocabulary(PATH)).count() == 0


def test_small_caches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 5)
    own = bpe.Codec(bpe.load_vocabulary(PATH))
    assert all(same(own, library, r[1] or "") for r in documents(2)[:40])


def test_a_vocabulary_that_merges_wholes_before_parts_is_refused(codec):
    v = bpe.load_vocabulary(PATH)
    late = next(m for m in v.merges if m[0] not in v.inner and m[0] not in v.final)
    with pytest.raises(ValueError, match="before its parts"):
        bpe.PrefixEncoder(bpe.Vocabulary(v.tokens, [late, *v.merges], v.inner, v.final, v.special))


def test_query_is_registered():
    assert "op8_bpe_prefix_dp" in queries.QUERIES
