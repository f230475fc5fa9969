"""Long texts without blanks: dealt out as leaves and groups of words, joined to what the tokenizer gives for the whole."""

import random

import brute
import pytest
from tokenizers import Tokenizer

from recallgrid.llm import bpe
from recallgrid.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")


def han(n, seed):
    rng = random.Random(seed)
    return "".join(chr(rng.choice([0x4E00, 0x3042, 0x00E9, 0x1F600]) + rng.randrange(40)) for _ in range(n))


def letters(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["ab", "the", "ing", "é", "tion", "z", "aaaa", "ST"]) for _ in range(n))


def code(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["var", "x1", "=", "(function", "){", "}", ";\n", "'s", "\t\t", "  ", "12345", "≠", "return"]) for _ in range(n))


TEXTS = {
    1: letters(60_000, 1),
    2: han(90_000, 2),
    3: code(40_000, 3),
    4: "a" * 150_000,
    5: "x " * 40_000 + letters(40_000, 4) + " then " + han(70_000, 5) + " y" * 20_000,
    6: letters(20_000, 6) + "<|endoftext|>" + letters(20_000, 7) + "<|endoftext|><|endoftext|>" + code(20_000, 8),
    7: " " * 70_000 + "end",
    8: "日" * bpe.LONG_TEXT + "\n" * 40_000 + "<|endoftext|>",
    9: "=" * 80_000 + letters(9_000, 9),
}


def test_long_texts_equal_the_tokenizer(frame):
    tok = Tokenizer.from_file(PATH)
    docs = [*TEXTS.items(), (1, TEXTS[1]), (1, TEXTS[2]), (None, TEXTS[3]), (10, "short"), (11, None)]
    want = {}
    for text in {t for _, t in docs}:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want[text] = (",".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False), len(ids))
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe.encode_documents(frame(docs), PATH).collect()), key=order)
    assert got == sorted(((d, *want[t][:2]) for d, t in docs), key=order)
    digests = sorted((tuple(r) for r in bpe.digest_documents(frame(docs), PATH).collect()), key=order)
    assert digests == sorted(((d, want[t][2], brute.sha(want[t][0]), brute.sha(want[t][1])) for d, t in docs), key=order)


@pytest.mark.parametrize("number", TEXTS)
def test_no_row_is_long(number):
    rows = list(bpe._section_rows(PATH)([number], [TEXTS[number]]))
    assert max(len(piece) for *_, piece in rows) <= 2 * bpe.SECTION
    assert len(rows) >= len(TEXTS[number]) // (2 * bpe.SECTION)
    leaves = [(part, what) for _, part, what, _ in rows if what >= 0]
    assert leaves == sorted(leaves) and (number not in (1, 4) or len({part for part, _ in leaves}) == 1)


def test_leaves_join_to_the_word():
    coder = bpe.pieces_for(PATH, "ids")
    for n, word in enumerate([letters(5_000, 11), "a" * 10_001, "".join(coder.letters[b] for b in han(3_000, 12).encode())]):
        for size in (700, 4_096):
            leaves = [coder.merged(word[at: at + size]) for at in range(0, len(word), size)]
            assert bpe.tree_join(leaves, coder.merged, coder.letters_of) == coder.merged(word), (n, size)
