"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

A text is read once, in pieces. Normalising, splitting and merging each keep only what later pieces can still change: a canonical segment, the
last word, and, within a word, as many symbols as the *sufficient lookahead*. That lookahead is how far to the right of a token boundary
text can still matter; the merge list fixes it, and it is computed once (:func:`sufficient_lookahead`). Tokens are emitted as soon as they are stable: at
the end of their word, or when the lookahead lies behind them. The decoder is an incremental state machine from token ids to text that
holds back at most the bytes of one unfinished character.

Edge cases: a null or empty text has no tokens; text of any length is encoded whole, in memory that doesn't grow with it or with a single long
word; strings of special tokens in a text become these tokens, as the public library does by default; pairs of equal rank merge from left to
right; repeated rows give repeated results; only the key and the text are read, so further columns can't clash; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quilt.llm.common import lean

SUFFIX = "</w>"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def _letter_class(prefix: str, most: int) -> str:
    """Ranges of the characters up to ``most`` whose general category begins with ``prefix``, for a character class."""
    out, run = [], None
    for c in range(most + 2):
        inside = c <= most and unicodedata.category(chr(c)).startswith(prefix)
        if inside and run is None:
            run = c
        elif not inside and run is not None:
            out.append((run, c - 1))
            run = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in out)


#: Texts up to this character are split with small, fast character classes; the result is the same.
LATIN = 0x24F
_BEYOND = re.compile(f"[^\\x00-{chr(LATIN)}]")


@functools.cache
def splitter(most: int = 0x10FFFE) -> re.Pattern:
    letters, numbers = _letter_class("L", most), _letter_class("N", most)
    space = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"[{letters}]+|[{numbers}]|'s|'t|'re|'ve|'m|'ll|'d|[^{space}{letters}{numbers}]+")


@functools.cache
def runs() -> tuple[re.Pattern, re.Pattern]:
    """Letters, and what is neither letter, number nor white space, as many as follow."""
    whole = splitter().pattern
    return re.compile(whole[: whole.index("+")] + "*"), re.compile(whole[whole.rindex("[") : -1] + "*")


def sufficient_lookahead(merges: list[tuple[str, str]], length=len) -> int:
    """Symbols to the right of a token's end after which its boundary can no longer change.

    A merge (a, b) can be foiled only by an earlier merge (x, y) that takes a token x from the right edge of b's derivation; that
    merge can in turn be foiled by a still earlier one from the right edge of y, and so on with falling ranks. The longest such
    chain, measured in symbols, is the lookahead. One pass over the merges in order of rank finds it.
    """
    parts: dict[str, tuple[str, str]] = {}
    reach: dict[str, int] = {}  # by left token of merges seen so far: symbols they can look to the right

    def edge(token: str) -> Iterator[str]:
        yield token
        while token in parts:
            token = parts[token][1]
            yield token

    most = 0
    for a, b in merges:
        far = length(b) + max((reach.get(x, 0) for x in edge(b)), default=0)
        reach[a] = max(reach.get(a, 0), far)
        most = max(most, far)
        parts.setdefault(a + b, (a, b))
    return most


class Words(dict):
    """What was made of words, bounded: when full, it becomes the old generation, from which words that come again are taken over."""

    def __init__(self, make, most: int = 1 << 17):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 256:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


@functools.cache
def joining() -> frozenset[str]:
    """Characters that normalisation can join with what stands before them: marks, and the later parts of compositions."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(0x80, 0x110000)):
        if unicodedata.combining(c):
            out.add(c)
        parts = unicodedata.decomposition(c).split(" ")
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def pieces_of(text: str, begin: int, end: int, size: int) -> Iterator[tuple[str, bool]]:
    """(piece, whether it ends inside a run without white space) of ``text[begin:end]``, cut where normalisation can't reach across."""
    at = begin
    while end - at > size:
        cut = max(text.rfind(" ", at + 1, at + size), text.rfind("\n", at + 1, at + size))
        inside = cut < 0
        if inside:
            cut = at + size
            while cut < end and text[cut] > "\x7f" and text[cut] in joining():
                cut += 1
        if cut < end:
            yield text[at:cut], inside
            at = cut
        else:
            break
    yield text[at:end], False


class WordStream:
    """Encoder of one word that arrives in pieces; the buffer never exceeds a block, a piece and the lookahead."""

    __slots__ = ("buffer", "t")

    def __init__(self, t: Transducer):
        self.t, self.buffer = t, []

    def push(self, data: bytes) -> list[int]:
        """Ids of the tokens that are stable now."""
        t, out = self.t, []
        for at in range(0, len(data), t.block):
            self.buffer += map(t.alphabet.__getitem__, data[at : at + t.block])
            while len(self.buffer) >= t.block + t.lookahead:
                settled, used = len(self.buffer) - t.lookahead - 1, 0
                for token in t.merge(self.buffer.copy()):
                    if used + len(token) > settled:
                        break
                    out.append(t.vocab[token])
                    used += len(token)
                if not used:
                    raise RuntimeError("no token became stable within the lookahead")
                del self.buffer[:used]
        return out

    def close(self) -> list[int]:
        """The word ends here."""
        if not self.buffer:
            return []
        self.buffer[-1] += SUFFIX
        out = [self.t.vocab[token] for token in self.t.merge(self.buffer)]
        self.buffer = []
        return out


class Decoder:
    """Incremental machine from token ids to text; :meth:`feed` takes further ids, :meth:`close` ends the text.

    With ``readable`` the tokens' bytes are decoded as UTF-8, at most one unfinished character is held back, and word ends become spaces. Else
    bytes become their printable stand-ins and a space parts the tokens, which is what a vocabulary file without a decoding step asks for.
    """

    def __init__(self, t: Transducer, readable: bool = False):
        self.t, self.readable, self.begun = t, readable, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        out = []
        for i in ids:
            if (token := self.t.bytes_of_token.get(i)) is None:
                continue
            data, ends, special = token
            if not self.readable:
                shown = self.t.shown[str(i)]
                out.append(" " + shown if self.begun else shown)
            elif special:
                out.append(self.machine.decode(b"", True) + special)
                self.machine.reset()
            else:
                out.append(self.machine.decode(data, ends) + " " * ends)
            self.begun = True
        return "".join(out)

    def feed_words(self, chunks: list[str]) -> str:
        """The same for words whose ids are in decimal and joined by spaces. Stand-ins carry no state from token to token but the space between them."""
        if not chunks:
            return ""
        ids = " ".join(chunks).split(" ")
        if self.readable:
            return self.feed(map(int, ids))
        out = " " * self.begun + " ".join(map(self.t.shown.__getitem__, ids))
        self.begun = True
        return out

    def close(self) -> str:
        return self.machine.decode(b"", True)


class Transducer:
    """Encoder and decoder of one vocabulary file of byte-level symbols with word ends."""

    def __init__(self, path: str, block: int = 4096, piece: int = 1 << 16):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != SUFFIX:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.alphabet = byte_alphabet()
        stand_ins = {c: b for b, c in self.alphabet.items()}
        #: Of each id: its bytes, whether a word ends with it, and the string of a special token.
        self.bytes_of_token = {i: (bytes(stand_ins[c] for c in x.removesuffix(SUFFIX)), x.endswith(SUFFIX), "") for x, i in self.vocab.items() if x not in self.special}
        self.bytes_of_token |= {i: (b"", False, x) for x, i in self.special.items()}
        self.lookahead = sufficient_lookahead(merges, lambda s: len(s.removesuffix(SUFFIX)))
        self.block, self.piece = max(block, 2 * self.lookahead), max(piece, 1024)
        self.special_find = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = Words(lambda w: " ".join(map(str, self.encode_word(w))))
        printable = "".join(self.alphabet[b] for b in range(256))
        #: Of each id in decimal, its bytes as printable stand-ins.
        self.shown = {str(i): special or data.decode("latin-1").translate(printable) + SUFFIX * ends for i, (data, ends, special) in self.bytes_of_token.items()}

    def forget(self) -> None:
        """Let go of the words met so far; a worker outlives its task."""
        self.words.clear()
        self.words.old = {}

    # encoding

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the merges by rank, then from left to right, to one bounded run of symbols."""
        n = len(symbols)
        if n <= 48:
            return self._merge_short(symbols)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := self.ranks.get((symbols[left], symbols[right]))) is not None:
                    heapq.heappush(heap, (r, left, symbols[left], symbols[right]))
        return [s for s, ok in zip(symbols, alive, strict=True) if ok]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        rank, none = self.ranks.get, len(self.ranks)
        pairs = [rank(p, none) for p in zip(symbols, symbols[1:])]  # noqa: B905
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            symbols[i] += symbols.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(pairs):
                pairs[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def stream_word(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one word that arrives in pieces."""
        word = WordStream(self)
        for piece in pieces:
            yield from word.push(piece)
        yield from word.close()

    def encode_word(self, word: str) -> list[int]:
        stream = WordStream(self)
        return stream.push(word.encode("utf-8", "surrogatepass")) + stream.close()

    def _normal(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # case is mapped character by character, without the final form
        return text.lower()

    def _split(self, text: str) -> list[str]:
        return (splitter() if _BEYOND.search(text) else splitter(LATIN)).findall(text)

    def _span(self, text: str, begin: int, end: int) -> Iterator[list[str]]:
        """Words of a stretch without special tokens, piece by piece: of each word its ids in decimal, joined by spaces."""
        rest, word, kind = "", None, None
        for piece, inside in pieces_of(text, begin, end, self.piece):
            piece = rest + self._normal(piece)
            rest, out = "", []
            if word:  # a word that is longer than a piece goes on as long as its kind of characters does
                run = kind.match(piece).end()
                ids = word.push(piece[:run].encode("utf-8", "surrogatepass"))
                piece = piece[run:]
                if piece or not inside:
                    ids += word.close()
                    word = None
                out += map(str, ids)
            found = self._split(piece)
            if inside and found and not word and piece.endswith(found[-1]):
                # what later text can change: the last word, and an apostrophe before it
                held = [found.pop()]
                if found and found[-1].endswith("'") and len(held[0]) == 1 and piece.endswith(found[-1] + held[0]):
                    held.insert(0, found.pop())
                rest = "".join(held)
                if len(held) == 1 and len(rest) > 256:
                    letters, others = runs()
                    kind = letters if letters.match(rest).end() else others
                    word = WordStream(self)
                    out += map(self.words.__getitem__, found)
                    out += map(str, word.push(rest.encode("utf-8", "surrogatepass")))
                    rest, found = "", []
            out += map(self.words.__getitem__, found)
            if out:
                yield out

    def stream(self, text: str | None) -> Iterator[list[str]]:
        """For each piece of a text, its words and special tokens, each as its ids in decimal, joined by spaces."""
        at, n = 0, len(text or "")
        if n and self.special_find and "<|" in text:
            for m in self.special_find.finditer(text):
                yield from self._span(text, at, m.start())
                yield [str(self.special[m[0]])]
                at = m.end()
        if at < n:
            yield from self._span(text, at, n)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for chunks in self.stream(text) for chunk in chunks for i in chunk.split(" ")]

    # decoding

    def token_strings(self, ids: Iterable[int]) -> Iterator[str]:
        """The stand-in string of each known token."""
        for i in ids:
            if out := Decoder(self).feed([i]):
                yield out

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, piece by piece."""
        machine = Decoder(self, readable=True)
        for i in ids:
            if out := machine.feed([i]):
                yield out
        if out := machine.close():
            yield out


@functools.lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string): ids of each whole text and their decoding back to readable text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [t.encode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(["".join(t.decode_stream(i)) for i in ids], pa.string())], names=[key, "ids", "decoded"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encoder and decoder run piece by piece, and each piece goes into the digests at once.

    ``decoded`` is what a vocabulary file without a decoding step asks for: the tokens' stand-in strings, parted by spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(1):
                count, one, two, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(t)
                for chunks in t.stream(x.as_py()):
                    ids = " ".join(chunks)
                    one.update((" " + ids if count else ids).encode())
                    two.update(decoder.feed_words(chunks).encode())
                    count += ids.count(" ") + 1
                two.update(decoder.close().encode())
                n.append(count)
                ids_sha.append(one.hexdigest())
                text_sha.append(two.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
        t.forget()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
