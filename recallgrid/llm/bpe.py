"""Encode and decode with public byte-pair tokenizers.

A text is cut where tokens can never span: before a blank that a non-blank follows (``byte_bpe``), or at white space
(``word_bpe``). Each distinct piece is encoded once per worker. A piece that is one long word is encoded as a tree: halves by
themselves, then growing windows of tokens around the join until the window agrees with both sides. Long texts are dealt
out as rows: sections between cuts, groups of words where a section has no cut, and leaves of words that are long themselves; leaves are
encoded in parallel tasks, and neighbours joined up the tree.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import arrow_pass

#: Distinct pieces that a worker remembers.
CACHE = 300_000
#: Code points above which a word is encoded as a tree.
LEAF = 512
#: Code points above which a text is dealt out in sections, and about how long a section, or a leaf in bytes, then is.
LONG_TEXT = 1 << 16
SECTION = LONG_TEXT // 4
#: What a dealt row holds: text as it is, or words in byte letters. Rows from 0 on are the leaves of one word, by number.
_TEXT, _WORDS = -2, -1

_BLANKS = re.compile(r" \s|\A\s|\s\Z")
_CUT = re.compile(r"(?= \S)")
#: Latin letters, marks that close them, and the same once more after a line break: letters, marks and breaks are tokens apart.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+", r"[.,!?;:*$%&|#<>()]*"
_PLAIN = re.compile(f"( ?{_LETTERS})({_MARKS})(?:(\n)({_LETTERS})({_MARKS}))?")
_RARE = re.compile("[\x1c-\x1f\x85]")


@functools.lru_cache(4)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def join_encoded(left: list[int], right: list[int], encode, text_of) -> list[int]:
    """Ids of the text of two halves of a word, given the ids of each.

    The text of the last and first w tokens is encoded again, w doubling, until the window's outermost tokens pair with their neighbours
    outside exactly as they stand: a pair stands if encoding its two texts together gives the pair back. A sequence whose neighbours
    all stand is the one encoding of its text.
    """
    def stands(a, b):
        return encode(text_of([a, b])) == [a, b]

    w = 4
    while w < max(len(left), len(right)):
        middle = encode(text_of(left[-w:] + right[:w]))
        if (len(left) <= w or stands(left[-w - 1], middle[0])) and (len(right) <= w or stands(middle[-1], right[w])):
            return left[:-w] + middle + right[w:]
        w *= 2
    return encode(text_of(left + right))


def tree_encode(word: str, encode, text_of) -> list[int]:
    """Ids of one word that the tokenizer does not split further, as ``encode`` (merges only) gives them for the whole."""
    if len(word) <= LEAF:
        return encode(word)
    half = len(word) // 2
    left, right = tree_encode(word[:half], encode, text_of), tree_encode(word[half:], encode, text_of)
    return join_encoded(left, right, encode, text_of)


def tree_join(leaves: list[list[int]], encode, text_of) -> list[int]:
    """Ids of a word from those of its leaves in order: neighbours joined two by two, up to the root."""
    while len(leaves) > 1:
        joined = [join_encoded(a, b, encode, text_of) for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = joined + leaves[len(joined) * 2:]
    return leaves[0]


class Pieces:
    """Encoder of pieces for one tokenizer file, with a bounded memory of distinct pieces."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.vocab = self.tok.get_vocab()
        self.names = {i: t for t, i in self.vocab.items()}
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        special = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        self.bytes_of = {
            i: t.encode() if i in special else bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
            for t, i in self.vocab.items()}
        self.letters, self.lower = letters, self.tok.normalizer is not None
        self.specials = tuple(special.values())
        self.known: dict[str, tuple] = {}

    def ids(self, piece: str) -> list[int]:
        if len(piece) <= LEAF or self.tok.normalizer is not None or any(s in piece for s in self.specials):
            return self.tok.encode(piece, add_special_tokens=False).ids
        out = []
        for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(piece):
            # These words come in byte letters already.
            out += tree_encode(word, self.merged, self.letters_of)
        return out

    def merged(self, word: str) -> list[int]:
        """Ids of a word in byte letters: merges only."""
        return [t.id for t in self.tok.model.tokenize(word)]

    def letters_of(self, ids: list[int]) -> str:
        return "".join(map(self.names.__getitem__, ids))

    def _merge(self, word: str) -> list[int]:
        """Ids of letters that are one word to the tokenizer: merges only."""
        return self.merged("".join(map(self.letters.__getitem__, word.encode())))

    def _add(self, piece: str, into: dict, value, join) -> None:
        """Put the value of an unknown piece into ``into``, from the words it consists of where these are plain letters."""
        m = _PLAIN.fullmatch(piece)
        if m is None or len(piece) > LEAF or (self.lower and (piece[0] == " " or m[3])):
            into[piece] = value(self.ids(piece))
            return
        parts = []
        for part in m.groups():
            if not part:
                continue
            low = part.lower() if self.lower else part
            found = self.known.get(low) or into.get(low)
            if found is None:
                found = into[low] = value(self._merge(low))
            parts.append(found)
        into[piece] = parts[0] if len(parts) == 1 else join(parts)

    def look_up(self, pieces: list[str], value, join) -> list:
        """The value of each piece. Up to ``CACHE`` pieces stay known to the worker; frequent ones come first by themselves."""
        known = self.known
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            new = set(pieces).difference(known)
        into = known if len(known) + 2 * len(new) <= CACHE else {}
        for p in new:
            self._add(p, into, value, join)
        if into is known:
            return list(map(known.__getitem__, pieces))
        return [known[p] if p in known else into[p] for p in pieces]


@functools.lru_cache(4)
def pieces_for(path: str, use: str) -> Pieces:
    return Pieces(path)


def cut_bytes(text: str) -> list[str]:
    """Pieces whose encodings concatenate to the text's, for byte-level tokenizers: cut before each blank that a non-blank follows."""
    if not _BLANKS.search(text):
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]
    return [p for p in _CUT.split(text) if p]


def encode_bytes(texts: list[str], path: str) -> list[list[int]]:
    """Ids of each text, as the tokenizer gives them without special tokens added."""
    coder = pieces_for(path, "ids")
    return [[i for ids in coder.look_up(cut_bytes(t), tuple, lambda p: sum(p, ())) for i in ids] for t in texts]


def decode_bytes(ids: list[int], path: str) -> str:
    coder = pieces_for(path, "ids")
    return b"".join(map(coder.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _section_rows(path):
    """Rows of long texts: document, part, what it holds (``_TEXT``, ``_WORDS`` or the number of a leaf), text."""
    def sections(text):
        start = 0
        for m in _CUT.finditer(text):
            if m.start() - start >= SECTION:
                yield text[start: m.start()]
                start = m.start()
        yield text[start:]

    def pieces(section, coder):
        """A section without cuts, in byte letters: short words put together, joined by blanks (no byte letter is one)."""
        held, size = [], 0
        for word, _ in coder.tok.pre_tokenizer.pre_tokenize_str(section):
            if held and size + len(word) > SECTION:
                yield [(_WORDS, " ".join(held))]
                held, size = [], 0
            if len(word) > SECTION:
                yield [(n, word[at: at + SECTION]) for n, at in enumerate(range(0, len(word), SECTION))]
            else:
                held.append(word)
                size += len(word)
        if held:
            yield [(_WORDS, " ".join(held))]

    def parts(text, coder):
        special = re.compile("(" + "|".join(map(re.escape, sorted(coder.specials, key=len, reverse=True))) + ")") if coder.specials else None
        for section in sections(text):
            if len(section) <= 2 * SECTION or coder.lower:
                yield [(_TEXT, section)]
                continue
            # The tokenizer takes its own control strings out of a text before anything else.
            for n, stretch in enumerate(special.split(section) if special else [section]):
                if n % 2:
                    yield [(_TEXT, stretch)]
                elif stretch:
                    yield from pieces(stretch, coder)

    def rows(docs, texts):
        coder = pieces_for(path, "ids")
        for doc, text in zip(docs, texts):
            for part, held in enumerate(parts(text, coder)):
                for what, piece in held:
                    yield doc, part, what, piece

    return rows


def _decimal(coder):
    """A piece's value: its ids in decimal, comma-joined, and the bytes that these ids decode to."""
    join, bytes_of = ",".join, coder.bytes_of

    def value(ids):
        return join(map(str, ids)), b"".join(map(bytes_of.__getitem__, ids))

    def together(parts):
        return join(p[0] for p in parts), b"".join(p[1] for p in parts)

    return value, together


def _coder_rows(path):
    def rows(keys, texts):
        coder = pieces_for(path, "decimal")
        value, together = _decimal(coder)
        for key, text in zip(keys, texts):
            found = coder.look_up(cut_bytes(text), value, together) if text else []
            ids = ",".join([f[0] for f in found if f[0]])
            yield key, ids, b"".join([f[1] for f in found]).decode("utf-8", "replace")

    return rows


def _decimals(ids) -> str:
    return ",".join(map(str, ids))


def _long_rows(long: DataFrame, path: str) -> DataFrame:
    """key, ids, decoded of long texts (key, text): their rows are encoded in parallel tasks, and put together by part and key."""
    dealt = arrow_pass(long, ["key", "text"], "key string, part int, what int, text string", _section_rows(path))
    plain = _coder_rows(path)

    def coded(keys, parts, whats, texts):
        coder = pieces_for(path, "ids")
        for key, part, what, text in zip(keys, parts, whats, texts):
            if what == _TEXT:
                _, ids, decoded = next(plain([key], [text]))
            else:
                words = text.split(" ") if what == _WORDS else [text]
                found = [i for w in words for i in tree_encode(w, coder.merged, coder.letters_of)]
                # A leaf may end inside a character, and its outer tokens are not final: it is decoded after its joins.
                ids, decoded = _decimals(found), decode_bytes(found, path) if what == _WORDS else None
            yield key, part, what, ids, decoded

    columns = "key string, part int, what int, ids string, decoded string"
    done = arrow_pass(dealt.repartition("key", "part", "what"), ["key", "part", "what", "text"], columns, coded)
    # At most the leaves of one word together: less than the row of its text.
    words = done.groupBy("key", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("what", "ids"))), lambda x: x["ids"]).alias("leaves"),
        F.max("decoded").alias("decoded"))

    def joined(keys, parts, leaves, decoded):
        coder = pieces_for(path, "ids")
        for key, part, found, text in zip(keys, parts, leaves, decoded):
            if text is not None:
                yield key, part, found[0], text
                continue
            ids = tree_join([[int(i) for i in leaf.split(",")] for leaf in found], coder.merged, coder.letters_of)
            yield key, part, _decimals(ids), decode_bytes(ids, path)

    whole = arrow_pass(words, ["key", "part", "leaves", "decoded"], "key string, part int, ids string, decoded string", joined)
    p = F.array_sort(F.collect_list(F.struct("part", "ids", "decoded")))
    return whole.groupBy("key").agg(p.alias("p")).select(
        "key", F.array_join(F.transform("p", lambda x: x["ids"]), ",").alias("ids"),
        F.array_join(F.transform("p", lambda x: x["decoded"]), "").alias("decoded"))


def _short_and_long(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Texts (null: empty) up to ``LONG_TEXT``: doc_id, text. Longer ones, encoded: doc_id, ids, decoded."""
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # A row's own key: repeated doc_ids must not mix. Equal rows (doc_id and text) share a key and count their copies.
    distinct = (base.filter(F.length("text") > LONG_TEXT)
                .groupBy("doc_id", F.sha2("text", 256).alias("h")).agg(F.any_value("text").alias("text"), F.count("*").alias("copies")))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "h", "copies")
    k = F.split("key", r"\|")
    copies = F.explode(F.sequence(F.lit(1), k[2].cast("int"))).alias("copy")
    done = _long_rows(distinct.select(key.alias("key"), "text"), path).select(
        F.expr("try_cast(split(key, '[|]')[0] AS BIGINT)").alias("doc_id"), "ids", "decoded", copies)
    return base.filter(F.length("text") <= LONG_TEXT), done.drop("copy")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (decimal, comma-joined), decoded: each text encoded, and its ids decoded again.

    Texts above ``LONG_TEXT`` are dealt out as rows that are encoded in parallel (see above) and put together by document.
    Null texts are empty and have no ids. Null doc_ids and repeated rows are kept; no rows give no rows.
    """
    short, long = _short_and_long(docs, path)
    return arrow_pass(short, ["doc_id", "text"], "doc_id long, ids string, decoded string", _coder_rows(path)).unionByName(long)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_documents`` without moving its short texts between processes."""
    short, long = _short_and_long(docs, path)
    rows = _coder_rows(path)

    def digests(keys, texts):
        for key, ids, decoded in rows(keys, texts):
            yield (key, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                   hashlib.sha256(decoded.encode("utf-8")).hexdigest())

    whole = arrow_pass(short, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
    return whole.unionByName(long.select(
        "doc_id", (F.length("ids") - F.length(F.replace("ids", F.lit(","), F.lit(""))) + 1).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")))


def word_ids(texts: list[str], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text, for tokenizers that drop white space: words are looked up one by one."""
    coder = pieces_for(path, "packed")

    def packed(ids):
        return struct.pack(f"<{len(ids)}I", *ids)

    for text in texts:
        # Control characters that only Python takes for blanks go through the tokenizer as they are.
        if _RARE.search(text):
            yield packed(coder.tok.encode(text, add_special_tokens=False).ids)
        else:
            yield b"".join(coder.look_up(text.split(), packed, b"".join))
