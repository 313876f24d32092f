"""Ids of op1 and op6 against the library, on words and code points where Unicode versions and normalisation matter."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarrystone.llm.bpe_lexicon import Bpe, Encoder, Lexicon, compile_lexicon
from quarrystone.llm.packed_ids import LibraryEncoder
from quarrystone.llm.queries import word_bpe
from quarrystone.llm.word_ids import WordIds

SPECIAL = "GELDİ. EVİ, İYİ! क़, שׁ. it's don't 'sun x''s 7 a7b 77 <|endoftext|> <|endoftext|>x a<|startoftext|> Σας ΟΔΟΣ. straße ÿÀ! µm ªº é ﬁ Ǆ. - -- a-b ... 😀. ﻿a ABİc ¨ Àb.,".split()
SPECIAL += ["\x1cx", "a\x1eb", "\x85q", "\xa0z", "́e", "é", "꟎", "\U00010d63", " k", "　", "x" * 5000, "(" * 3000]


def random_texts(seed: int, n: int) -> list[str]:
    r, out = random.Random(seed), ["", "  ", " a ", "\n"]
    ranges = ((32, 127), (0xA0, 0x600), (0x900, 0x3000), (0x1E00, 0x2100), (0xA640, 0xAC00), (0x10000, 0x1F000), (0x300, 0x370))
    for _ in range(n):
        words = []
        for _ in range(r.randrange(1, 9)):
            q = r.random()
            if q < 0.4:
                words.append(r.choice(SPECIAL))
            elif q < 0.8:
                words.append("".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randrange(1, 7))))
            else:
                words.append("".join(r.choice("abcdEFGÀß.,'7 ") for _ in range(r.randrange(1, 8))))
        out.append(r.choice([" ", "\n", "\t", " \n ", "　"]).join(words))
    return out


@pytest.mark.parametrize("keep_bytes", [24 << 20, 20_000])
def test_ids_are_the_librarys(keep_bytes):
    library, texts = Tokenizer.from_file(word_bpe()), random_texts(1, 10_000)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    bpe = Bpe(word_bpe())
    for enc in (LibraryEncoder(word_bpe()), Encoder(word_bpe(), None)):
        assert isinstance(enc.words, WordIds)
        enc.words.keep_bytes = keep_bytes
        for at in range(0, len(texts), 700):
            ids, stops = enc.encode(pa.array(texts[at : at + 700]))
            got = [ids[a:z].tolist() for a, z in zip([0, *stops.tolist()], stops.tolist(), strict=False)]
            assert got == want[at : at + 700]
        assert enc.words.words.nbytes < 4_000_000
    assert bpe.parts("") == []


def test_other_settings_go_to_the_library_whole(tmp_path):
    import json

    with open(word_bpe(), encoding="utf-8") as f:
        data = json.load(f)
    data["normalizer"]["normalizers"] = data["normalizer"]["normalizers"][:2]
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f)
    enc, library = LibraryEncoder(path), Tokenizer.from_file(path)
    assert not enc.by_word
    ids, stops = enc.encode(pa.array(["Ab Cd", "", "x"]))
    assert ids.tolist() == [i for t in ("Ab Cd", "", "x") for i in library.encode(t, add_special_tokens=False).ids] and len(stops) == 3


def test_lexicon_finds_its_words_and_no_others(tmp_path):
    r = random.Random(2)
    words = {bytes(r.choices(b"abc", k=r.randrange(1, 7))) for _ in range(300)}
    entries = {w: [k, 2 * k] for k, w in enumerate(sorted(words))}
    (tmp_path / "lex").write_bytes(compile_lexicon(entries))
    lexicon = Lexicon(str(tmp_path / "lex"))
    for _ in range(3000):
        w = bytes(r.choices(b"abcd", k=r.randrange(1, 8)))
        got = lexicon.get(w)
        assert (got is None) == (w not in entries)
        if got:
            assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == entries[w]


def test_words_are_looked_up_and_merged_together(tmp_path):
    """Words of a batch at once as one by one, of all lengths around those that share a matrix, with and without a lexicon."""
    import numpy as np

    r, bpe, library = random.Random(3), Bpe(word_bpe()), Tokenizer.from_file(word_bpe())
    words = ["".join(r.choices("etaoinsh,.'é7", k=r.choice([1, 2, 3, 5, 9, 20, 63, 64, 65, 200]))).encode() for _ in range(3000)] + [b"a" * 64, b"e" * 65]
    sizes = np.array([len(w) for w in words])
    data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
    ids, counts = bpe.merge_all(data, starts, sizes)
    want = [bpe.merge(w) for w in words]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert len(bpe.merge_all(data, starts[:0], sizes[:0])[0]) == 0

    known = sorted(set(words[::3]))
    path = tmp_path / "lex"
    path.write_bytes(compile_lexicon({w: bpe.merge(w) for w in known}))
    lexicon = Lexicon(str(path))
    assert lexicon.places(data, starts, sizes).tolist() == [known.index(w) if w in known else -1 for w in words]
    path.write_bytes(compile_lexicon({}))
    assert set(Lexicon(str(path)).places(data, starts, sizes).tolist()) == {-1}

    texts = random_texts(4, 2000) + [w.decode(errors="replace") for w in words]
    pieces = {p.encode() for t in texts[::2] for w in t.split() for p in bpe.parts(w) if isinstance(p, str)}
    path.write_bytes(compile_lexicon({w: bpe.merge(w) for w in pieces}))
    enc = Encoder(word_bpe(), str(path))
    for at in range(0, len(texts), 700):
        ids, stops = enc.encode(pa.array(texts[at : at + 700]))
        assert [ids[a:z].tolist() for a, z in zip([0, *stops.tolist()], stops.tolist(), strict=False)] == [e.ids for e in library.encode_batch(texts[at : at + 700], add_special_tokens=False)]
