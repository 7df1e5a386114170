import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lodestone.llm import packing as m


def check(rows, got, length, eos=1):
    """Pieces rebuild every document's ids, sequences are gapless and full."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*e.ids, eos], "<u4") for e in tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    total = sum(map(len, ids))
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sorted(by_seq) == list(range(-(-total // length)))
    for k, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == (length if k < len(by_seq) - 1 else total - length * (len(by_seq) - 1))
    assert sum(r.length for r in got) == total
    want = sorted((str(d), len(x)) for (d, _), x in zip(rows, ids, strict=True))
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got if r.start == 0) == want
    known = {}
    for (d, _), x in zip(rows, ids, strict=True):
        known.setdefault((d, len(x)), []).append(x)
    for r in got:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in known[r.doc_id, r.doc_tokens])


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, m.query(spark, sf).collect(), 2048)


def test_edges(spark):
    rows = [(None, None), (1, ""), (1, None), (2, "it's we'll <|endoftext|> a|b"), (3, " \n\n  x\r\n y \t\tz  "), (4, "a b c 12ab ab12 ½³ é́ あい \U0001f600"), (5, "long " * 9000)]
    rows += [(6, "   "), (7, "\n"), (8, "x"), (8, "x"), (9, "\x85\x1c\x00 a"), (10, " !?.. ab  cd"), (11, "ÀÉ  ß\n\nà'")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS task").repartition(3)
    for length in (8, 100, 2048):
        check(rows, m.pack(df, length=length).collect(), length)


def test_known_pieces_start_anew(spark, monkeypatch):
    monkeypatch.setattr(m, "REMEMBERED", 5)
    enc = m.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"word{i} and {i * 7} more words" for i in range(50)]
    for i in range(0, 50, 10):
        ids, bounds = enc.rows(pa.array(texts[i : i + 10]))
        for k, t in enumerate(texts[i : i + 10]):
            assert list(ids[bounds[k] : bounds[k + 1]]) == enc.tokenizer.encode(t, add_special_tokens=False).ids


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def same_as_library(enc, texts):
    ids, bounds = enc.rows(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert list(ids[bounds[k] : bounds[k + 1]]) == enc.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_pieces_of_like_structure():
    enc = m.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = [thue_morse(n) for n in (1024, 2048)]
    same_as_library(enc, words + [w.translate(str.maketrans("ab", "ba")) for w in words])


def test_colliding_hashes(monkeypatch):
    """Pieces with one hash: in one chunk, and with a known piece of an earlier one."""
    whole = m.tk.bytes_hash
    monkeypatch.setattr(m.tk, "bytes_hash", lambda *a: whole(*a) % m.tk.U64(5))
    enc = m.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for part in (["one two three four", "one", None, "two two"], ["five six", "one", "seven eight nine ten", ""]):
        same_as_library(enc, part)


def test_every_character_of_the_first_plane():
    enc = m.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    codes = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    same_as_library(enc, ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}. " for c in codes[i : i + 64]) for i in range(0, len(codes), 64)])


def test_other_vocabularies(spark):
    """Another split goes to the library whole."""
    path = public_tokenizers.path("word_bpe_49k.json")
    same_as_library(m.Encoder(path), ["Some words, 12 of them.", "  X\n\ny ", None, "it's"])


def test_empty(spark):
    assert m.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
