"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

What the merges make of a pre-token is the one sequence of tokens in which every two neighbours are compatible: merging the
letters of both, in the order of the merges, never joins the two across their border. So a pre-token needs no merging: an
Aho-Corasick automaton of all tokens gives the longest token that starts at each place; the encoder takes it if it is
compatible with the token before it, else the next shorter token that starts there, and where none is left it takes back the
token before and marks the place as a dead end. Each place is visited for at most its tokens, so the time is linear. Whether a
pair is compatible is worked out once from the merges on either side of the border (`joined_at`) and kept in a table.
Tokens that the merges don't make of their own letters are left out of the automaton.

A text is cut at white space, which the pre-tokeniser drops, and before some marks after a letter; each distinct word of a
block of the text is normalised and cut into pre-tokens (by the file's own rules), and each distinct pre-token encoded once. A
worker keeps the ids of both in tables that are emptied when they hold TABLE_BYTES. That changes the time but never a result. Strings of added tokens get their ids wherever they stand.
Decoding joins the tokens' strings by one space, as a file without a decoder does: a table of all strings with the places
where they start turns any number of ids into text by one gather.

`check_model` refuses files for which this doesn't hold. Null texts are taken as empty and have no ids. Texts are never cut:
blocks end at white space, and a single word is held whole with its tokens. Repeated rows give repeated results, an empty table
an empty one; extra columns are kept by `keep` and may have any name but those of the results.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from silkloom.llm.common import sliced

#: Bytes of words and ids that a worker keeps, characters of a text and ids that are worked on at a time, pairs that are kept.
TABLE_BYTES, BLOCK, IDS, PAIRS = 200_000_000, 200_000, 500_000, 1_000_000
#: Unicode's white space.
SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE = re.compile(f"[{''.join(map(chr, SPACES))}]+")
#: Marks that the pre-tokeniser sets apart from a letter before them, so a space there changes nothing: "word" and "word," are
#: one word of the table.
MARK = re.compile("(?<=[A-Za-z])[.,;:!?)]")
#: Added to the code of a letter that ends a pre-token.
LAST = 0x10000
NEVER = 1 << 62


class Merges:
    """Tokens as strings of letters, the rank at which a pair is merged, and which pairs of tokens are compatible."""

    def __init__(self, spec: dict):
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.letters: dict[str, int] = {}
        for word, i in ids.items():
            if len(word) == 1:
                self.letters[word] = i
            if end and word.endswith(end) and len(word) == len(end) + 1:
                self.letters[chr(LAST + ord(word[0]))] = i
        self.ends = bool(end)
        spelled = {i: letter for letter, i in self.letters.items()}
        #: Of a token: the rank that makes it, and its two parts; letters have none.
        self.made: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = ids[left], ids[right], ids[left + right]
            if c in spelled or a not in spelled or b not in spelled:
                raise ValueError(f"the merge of {left!r} and {right!r} isn't the only one of its token, or comes before its parts")
            spelled[c] = spelled[a] + spelled[b]
            self.made[c], self.rank[a, b] = (rank, a, b), rank
        self.fits: dict[tuple[int, int], bool] = {}
        #: Tokens that the merges make of their own letters; parts come before what is made of them.
        self.whole = set(self.letters.values())
        for c, (rank, a, b) in self.made.items():
            if a in self.whole and b in self.whole and self.joined_at(a, b) == rank:
                self.whole.add(c)
        self.spelled = {i: spelled[i] for i in self.whole}
        self.tokens = {s: i for i, s in self.spelled.items()}
        self.sizes = {i: len(s) for i, s in self.spelled.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.tokens.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """(rank at which it goes into the next one, part) of the parts of a token at its left (1) or right (2) border,
        from its letter up."""
        found, until = [], NEVER
        while True:
            found.append((until, token))
            if token not in self.made:
                return found[::-1]
            until, token = self.made[token][0], self.made[token][side]

    def joined_at(self, a: int, b: int) -> int | None:
        """The rank of the first merge across the border of a and b, None if they stay apart.

        Merges happen by rank, those of a rank from left to right. A merge of the two parts at the border comes first if
        it's before the one that makes the left part grow, and not after the one that makes the right part grow.
        """
        left, right = self._border(a, 2), self._border(b, 1)
        i = j = 0
        while True:
            (grows_left, x), (grows_right, y) = left[i], right[j]
            rank = self.rank.get((x, y), NEVER)
            if rank < grows_left and rank <= grows_right:
                return rank
            if grows_left == grows_right == NEVER:
                return None
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        fits = self.fits.get((a, b))
        if fits is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            fits = self.fits[a, b] = self.joined_at(a, b) is None
        return fits

    def encode(self, word: str) -> list[int]:
        """Ids of a pre-token, given by its letters."""
        if self.ends:
            word = word[:-1] + chr(LAST + ord(word[-1]))
        if (token := self.tokens.get(word)) is not None:
            return [token]
        # The longest token, then the longest after it, and so on: right as it stands if all neighbours are compatible.
        found = [token for _, (_, token) in self.automaton.iter_long(word)]
        size = sum(map(self.sizes.__getitem__, found))
        return found if size == len(word) and all(map(self.compatible, found, found[1:])) else self._backtracked(word)

    def _backtracked(self, word: str) -> list[int]:
        longest: list[tuple[int, int]] = [(0, 0)] * len(word)
        for last, (size, token) in self.automaton.iter(word):
            longest[last - size + 1] = (size, token)  # matches come by their ends, so the longest of a place comes last
        found: list[int] = []
        places: list[int] = []
        dead: set[int] = set()
        at = 0
        size, token = longest[0]
        while at < len(word):
            while size and (at + size in dead or found and not self.compatible(found[-1], token)):
                size, token = self._shorter(word, at, size)
            if size:
                found.append(token)
                places.append(at)
                at += size
                size, token = longest[at] if at < len(word) else (0, 0)
            else:
                dead.add(at)
                token, before = found.pop(), places.pop()
                size, at = at - before, before
        return found

    def _shorter(self, word: str, at: int, size: int) -> tuple[int, int]:
        """The next shorter token that starts there."""
        for n in range(size - 1, 0, -1):
            if (token := self.tokens.get(word[at : at + n])) is not None:
                return n, token
        return 0, 0


class OffsetTable:
    """Strings by id, each with the separator after it, one after the other with the places where they start."""

    def __init__(self, strings: list[str], separator: str = " "):
        data = [s.encode() + separator.encode() for s in strings]
        self.ends = len(separator.encode())
        self.data = np.frombuffer(b"".join(data), np.uint8)
        self.starts = np.cumsum([0, *map(len, data)])

    def joined(self, ids: np.ndarray) -> bytes:
        """The strings of the ids, with a separator after the last one too."""
        sizes = self.starts[ids + 1] - self.starts[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.data[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes()

    def pieces(self, ids: np.ndarray):
        """The joined strings without the last separator, some at a time."""
        for s in range(0, len(ids), IDS):
            data = self.joined(ids[s : s + IDS])
            yield data if s + IDS < len(ids) else data[: len(data) - self.ends]


def check_model(path: str) -> None:
    """Raise ValueError unless the file is a BPE of this kind, whose words are independent."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], spec["added_tokens"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        raise ValueError("not a plain BPE")
    if spec["decoder"] is not None or spec["normalizer"] is None or spec["pre_tokenizer"] is None:
        raise ValueError("not a file with a normaliser and a pre-tokeniser, without a decoder")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or SPACE.search(t["content"]) for t in added):
        raise ValueError("an added token that looks across white space")
    tokenizer = Tokenizer.from_file(path)
    if any(MARK.search(t["content"]) for t in added):
        raise ValueError("an added token with a mark after a letter")
    letters = Merges(spec).letters
    if {chr(c) for c in range(33, 127)} - set(letters) or len(letters) != 256 * (1 + bool(model["end_of_word_suffix"])):
        raise ValueError("letters are missing")
    doubtful = (*range(1, 33), 0x180E, 0x200B, 0x2060, 0xFEFF, *SPACES)
    for c in ".,;:!?)":
        if [w[-1] for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}{c}b")] != ["a", c, "b"]:
            raise ValueError(f"{c!r} is not set apart")
    for c in map(chr, doubtful):
        cut = len([w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(f"a{c}b"))]) == 2 and tokenizer.normalizer.normalize_str(f"a{c}{c}b") == "a b"
        if cut != bool(SPACE.fullmatch(c)):
            raise ValueError(f"white space is not what is dropped: {c!r}")


class Coder:
    """A tokenizer file's encoder and decoder, with the ids of the words met so far."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        self.merges, self.table_bytes = Merges(spec), table_bytes
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cuts = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None
        size = 1 + max(*spec["model"]["vocab"].values(), *self.added.values(), 0)
        strings = {i: s for s, i in (spec["model"]["vocab"] | self.added).items()}
        self.strings = OffsetTable([strings.get(i, "") for i in range(size)])
        self.numbers = OffsetTable([str(i) for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space and added tokens, normalised and cut together."""
        text = self.normalizer.normalize_str("\n".join(words))
        parts = text.split(" ")
        if len(parts) != len(words):
            raise ValueError("the normaliser makes or drops white space")
        starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        letters, spans = zip(*self.pre_tokenizer.pre_tokenize_str(text))
        owner = np.searchsorted(starts, [s for s, _ in spans], "right") - 1
        for new in set(letters).difference(self.pieces):
            self.pieces[new] = data = array("I", self.merges.encode(new)).tobytes()
            self.held += len(new) + len(data) + 200
        found = list(map(self.pieces.__getitem__, letters))
        cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        return [b"".join(found[s:e]) if e - s != 1 else found[s] for s, e in zip(cuts, cuts[1:])]

    def fill(self, new: list[str]) -> None:
        """Keep the ids of new words."""
        plain, split = new, {}
        if self.cuts and (odd := [w for w in new if self.cuts.search(w)]):
            split = {w: [p for p in self.cuts.split(w) if p] for w in odd}
            plain = list({p for parts in split.values() for p in parts if p not in self.added}.union(new).difference(odd))
        coded = dict(zip(plain, self.words(plain))) if plain else {}
        for w, parts in split.items():
            coded[w] = b"".join(array("I", [self.added[p]]).tobytes() if p in self.added else coded[p] for p in parts)
        self.known |= coded
        self.held += sum(map(len, coded)) + sum(map(len, coded.values())) + 200 * len(coded)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text."""
        found = []
        for block in blocks(text or "", BLOCK):
            if self.held > self.table_bytes:
                self.known, self.pieces, self.held = {}, {}, 0
            words = [w for w in SPACE.split(MARK.sub(r" \g<0>", block)) if w]
            if new := list(set(words).difference(self.known)):
                self.fill(new)
            found.append(b"".join(map(self.known.__getitem__, words)))
        return np.frombuffer(b"".join(found), np.uint32).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.strings.pieces(ids)).decode()


def blocks(text: str, size: int):
    """The text in pieces of about this many characters that end at white space."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One for each file, kept by the worker from task to task."""
    return Coder(path)


def _digest(pieces) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p)
    return h.hexdigest()


def encode_decode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), payload: bool = False) -> DataFrame:
    """keep columns, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256; with payload also ids
    (array<int>) and decoded."""
    check_model(model)
    chosen = docs.select(*keep, docs[text].alias("__text"))
    extra = ", ids array<int>, decoded string" if payload else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")
    schema += f", n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"

    def run(batches):
        c = coder(model)
        for b in sliced(batches):
            n, said, told, ids, texts = [], [], [], [], []
            for t in b.column("__text"):
                got = c.encode(t.as_py())
                n.append(len(got))
                said.append(_digest(c.numbers.pieces(got)))
                told.append(_digest(c.strings.pieces(got)))
                if payload:
                    ids.append(got.astype(np.int32))
                    texts.append(c.decode(got))
            out = [*(b.column(k) for k in keep), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(told, pa.string())]
            out += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if payload else []
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if payload else [])])

    return chosen.mapInArrow(run, schema)
