"""Cross-tokenizer alignment against the tokenizers themselves and plain counting."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from recallgrid.llm import alignment, bpe
from recallgrid.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
PATHS = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a  b", " lead", "trail ", "\n x\n\n y", "a▁b", "<|endoftext|> <s></s>", "x" * 3000, "ab " * 50,
       "日本語 のテキスト  です", "é́ ﬁ Ⅳ 😀😀", " " * 700 + "x", "a  b  c", "\x00\x01 \x1c a\x85 b", "don't 123 4567", "Ⅳ" * 600,
       "a\tb \tc  \t d", " \n \n", "x \n", "one,\nTwo three.", "word " * 30_000]


@pytest.fixture(scope="module")
def plain():
    """(n_a, n_b, groups, links) of a text, or None."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    back = {c: i for i, c in enumerate(bpe.byte_letters())}
    of_a = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in a.get_vocab().items()}

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def align(text):
        if not text:
            return None
        raw, x, y = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if b"".join(of_a[t] for t in x) != raw or b"".join(map(of_b, y)) != raw:
            return None
        ends_x, ends_y = np.cumsum([len(of_a[t]) for t in x]), np.cumsum([len(of_b(t)) for t in y])
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_x.tolist()) & set(ends_y.tolist())):
            k, m = int(np.searchsorted(ends_x, end)) + 1, int(np.searchsorted(ends_y, end)) + 1
            groups.append((x[i:k], y[j:m]))
            i, j = k, m
        return len(x), len(y), groups, Counter((p, q) for g in groups for p in g[0] for q in g[1])

    return align


def brute(docs, align):
    found = [(d, align(t)) for d, t in docs]
    df = Counter(pair for _, f in found if f for pair in f[3])
    best = {}
    for (p, _), n in df.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, n_a, n_b, len(groups), sum(links.values()), sum(n for k, n in links.items() if df[k] == best[k[0]]),
                    sum(n * df[k] for k, n in links.items()), hashlib.sha256(told.encode()).hexdigest()))
    return out


def told(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("records, fan_in, slice_records", [(1 << 19, 512, 8_000_000), (4000, 3, 500)])
def test_alignment(frame, plain, monkeypatch, records, fan_in, slice_records):
    """One run a task, and many runs, merged in rounds, their counts going back by slices."""
    monkeypatch.setattr(alignment, "FAN_IN", fan_in)
    monkeypatch.setattr(alignment, "SLICE_RECORDS", slice_records)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()[:60]
    docs += [(900_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), docs[0], docs[0], (docs[1][0], "another text")]
    got = alignment.aligned_documents(frame(docs).repartition(3), *PATHS, run_records=records)
    assert told(got) == sorted(brute(docs, plain), key=repr)


def test_alignment_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned_documents(docs, *PATHS).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert told(alignment.aligned_documents(nothing, *PATHS)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_chunks_are_cut_where_no_token_spans(plain):
    for text in filter(None, ODD):
        whole, parts = plain(text), [plain(c[1:]) for c in alignment.chunks_of(text) if c != " "]
        if whole and all(parts):
            assert [g for p in parts for g in p[2]] == whole[2], text


def test_wide_groups_count_their_ids_first(monkeypatch):
    """Both ways of pairing the ids of a group give the same pairs, as often."""
    aligner = alignment.Aligner(*PATHS)
    chunks = [" zqxj" * 3, " Ⅳ" * 9, " abcabcabc,", " plain", " of\nwords"]
    before = aligner.align(chunks)
    monkeypatch.setattr(alignment, "WIDE", 2)
    for one, other in zip(before, aligner.align(chunks)):
        assert one[:2] == other[:2]
        counts = []
        for _, _, pairs, times in (one, other):
            pairs = np.frombuffer(pairs, np.uint64)
            counts.append(Counter())
            for p, n in zip(pairs.tolist(), np.frombuffer(times, np.uint32).tolist() if times else [1] * len(pairs)):
                counts[-1][p] += n
        assert counts[0] == counts[1]


def test_known_chunks_stay_bounded(monkeypatch):
    aligner = alignment.Aligner(*PATHS)
    monkeypatch.setattr(alignment, "CACHE", 50)
    for start in range(0, 300, 30):
        chunks = [f" w{i}" for i in range(start, start + 40)]
        known = aligner.look_up(chunks)
        assert [known[c] for c in chunks] == aligner.align(chunks) and len(aligner.known) <= 50
    many = [f" v{i}" for i in range(200)]
    assert set(many) <= set(aligner.look_up(many)) and len(aligner.known) <= 50


def test_merge_and_maxima():
    shift = alignment.ID_BITS
    runs = [[(1 << shift | 5, 2), (3 << shift | 1, 1)], [(1 << shift | 5, 1), (1 << shift | 7, 3)], []]
    assert list(alignment.with_maxima(alignment.merged([iter(r) for r in runs]))) == [
        (1 << shift | 5, 3, 1), (1 << shift | 7, 3, 1), (3 << shift | 1, 1, 1)]
    rows = np.array([(i, i % 7) for i in range(5000)], alignment.ENTRY)
    assert list(alignment._stream([alignment.pack(rows[:3001]), alignment.pack(rows[3001:])])) == [(i, i % 7) for i in range(5000)]
