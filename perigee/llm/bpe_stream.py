"""Byte-level BPE as a streaming transducer, and its decoding.

A text is fed in chunks.  A scanner cuts it into pieces (added tokens, words with their blank, numbers,
signs, blanks); a piece is certain as soon as a character after it is known, and a piece that
goes on and on is passed on in parts.  Pieces are merged inside a window of bytes.

*Sufficient lookahead.*  How far left can unknown bytes behind the window change its tokens?  Run the
merge list rule by rule over two texts that agree up to a place: where they differ moves left only if a
rule (a, b) joins across it, by the length of a.  The next rule to move it must come later in the list
and its right part must begin with a.  The longest such chain of rules, by the lengths of their left
parts, is computed from the merge list in one pass (``Tokenizer.lookahead``).  Tokens that end so far before the end of the
window stand whatever follows: they are emitted and their bytes forgotten.  Memory for a text therefore is
one chunk and one window, whatever the length of the text or of its pieces.

Short pieces repeat: their tokens are kept in a table of bounded size.

Decoding joins the bytes of a chunk of ids and walks them through an incremental UTF-8 state machine, which
holds at most three bytes back; malformed bytes become U+FFFD, one for each longest wrong beginning.

Defined results: NULL texts and NULL lists of ids count as empty; ids that the vocabulary lacks, NULL among them, decode to nothing.
Equal rows give equal results, extra columns are not looked at, an empty table gives an empty table.  A merge
list that uses a token before the rule that makes it, and settings that are not of this kind, are refused.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from perigee.llm import arrays as ar

CHUNK = 1 << 16
SHORT = 32
KEPT_PIECES = 1 << 17
FEW_BYTES = 48
NO_RULE, NO_TOKEN = 1 << 62, -1
MOST_FILE_BYTES = 64 << 20

# The pattern of pieces, and the letters and numbers that came after Unicode 16, which the
# vocabulary's own library counts as signs.
PIECE = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
AFTER_UNICODE_16 = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)

PIECES = regex.compile(PIECE)
NEWER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in AFTER_UNICODE_16) + "]")
# What a piece that has become long goes on with, by its last character.
RUNS = {name: regex.compile(f"{kind}*") for name, kind in (("letters", r"\p{L}"), ("numbers", r"\p{N}"), ("blanks", r"\s"), ("signs", r"[^\s\p{L}\p{N}]"))}
A_SIGN = "!"


def _as_unicode_16(text: str) -> str:
    """The text with a sign for each newer letter or number; the same object if it holds none."""
    try:
        # Most texts need no search: the first such character is far above Latin-1.
        text.encode("latin-1")
    except UnicodeEncodeError:
        return NEWER.sub(A_SIGN, text) if NEWER.search(text) else text
    return text


def _letters_of_bytes() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = _letters_of_bytes()


class Tokenizer:
    """A byte-level BPE vocabulary: ids, merges, added tokens, and the lookahead that its merge list needs."""

    def __init__(self, spec: dict):
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        unused = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if (
            model.get("type", "BPE") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True)
            or spec.get("normalizer") or any(model.get(key) for key in unused)
            or any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", ()))
        ):
            raise ValueError("not a plain byte-level BPE vocabulary")
        ids = {bytes(LETTERS[c] for c in token): i for token, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ()) if t["content"]}
        self.bytes = {i: token for token, i in ids.items()}
        for text, i in self.added.items():
            self.bytes[i] = bytes(LETTERS[c] for c in text) if all(c in LETTERS for c in text) else text.encode()
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        # By left token and right token the place of their rule in the list, and the token that each rule makes.
        self.rules: list[dict[int, int]] = [{} for _ in range(max(ids.values()) + 1)]
        self.made: list[int] = []
        merges = (pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"])
        self.longest = 1
        self.lookahead = self._rules([tuple(bytes(LETTERS[c] for c in part) for part in pair) for pair in merges], ids)
        self.window = 4 * self.lookahead + self.longest
        # Longer added tokens first: at one place the longest counts.
        found = sorted(self.added, key=lambda t: (-len(t), t))
        self.special = regex.compile("|".join(map(regex.escape, found))) if found else None
        self.pieces = _Pieces(self)

    def _rules(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]) -> int:
        """Fills ``rules`` and ``made`` and returns the sufficient lookahead in bytes."""
        begins: dict[bytes, bytes | None] = {bytes([b]): None for b in range(256)}
        reach: dict[bytes, int] = {}
        most = 0
        for rank, (a, b) in enumerate(merges):
            if a not in begins or b not in begins:
                raise ValueError(f"merge {rank} uses a token that no earlier merge makes")
            chain, first = 0, b
            while first is not None:
                chain, first = max(chain, reach.get(first, 0)), begins[first]
            reach[a] = max(reach.get(a, 0), chain + len(a))
            most = max(most, reach[a])
            begins.setdefault(a + b, a)
            self.rules[ids[a]].setdefault(ids[b], rank)
            self.made.append(ids[a + b])
            self.longest = max(self.longest, len(a + b))
        return most

    def merge(self, data: bytes) -> list[int]:
        """Tokens of these bytes: the earliest rule first, the leftmost place first."""
        token = [self.of_byte[b] for b in data]
        return self._merge_few(token) if len(token) <= FEW_BYTES else self._merge_many(token)

    def _merge_few(self, token: list[int]) -> list[int]:
        rules = self.rules
        ranks = [rules[a].get(b, NO_RULE) for a, b in zip(token, token[1:])]
        while ranks and (first := min(ranks)) < NO_RULE:
            i = ranks.index(first)
            new = token[i] = self.made[first]
            del token[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rules[new].get(token[i + 1], NO_RULE)
            if i:
                ranks[i - 1] = rules[token[i - 1]].get(new, NO_RULE)
        return token

    def _merge_many(self, token: list[int]) -> list[int]:
        """The same with a heap of places and links between neighbours."""
        n, rules = len(token), self.rules
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i, (a, b) in enumerate(zip(token, token[1:])) if (rank := rules[a].get(b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= n or rules[token[i]].get(token[j]) != rank:
                continue
            token[i], token[j] = self.made[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (rank := rules[token[left]].get(token[right])) is not None:
                    heapq.heappush(heap, (rank, left))
        return [t for t in token if t >= 0]


class _Pieces(dict):
    """Tokens by piece; short ones are kept, in two tables of bounded size: a full one becomes the older one."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.older = tokenizer, {}

    def __missing__(self, piece: str) -> list[int]:
        if len(piece) > SHORT:
            window = _Window(self.tokenizer)
            return window.feed(piece.encode()) + window.close()
        if len(self) >= KEPT_PIECES:
            self.older = dict(self)
            self.clear()
        found = self[piece] = self.older.get(piece) or self.tokenizer.merge(piece.encode())
        return found


class _Window:
    """Bytes of one piece whose tokens may still change."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.held = tokenizer, b""

    def feed(self, data: bytes) -> list[int]:
        t, out, at = self.tokenizer, [], 0
        data = self.held + data
        while len(data) - at > t.window:
            stable = at + t.window - t.lookahead
            for token in t.merge(data[at : at + t.window]):
                end = at + len(t.bytes[token])
                if end > stable:
                    break
                out.append(token)
                at = end
        self.held = data[at:]
        return out

    def close(self) -> list[int]:
        out, self.held = self.tokenizer.merge(self.held), b""
        return out


class Encoder:
    """Tokens of one text that arrives in chunks: ``feed`` each, then ``finish``."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.rest = tokenizer, ""
        self.run: str | None = None
        self.window = _Window(tokenizer)

    def feed(self, chunk: str, last: bool = False) -> list[int]:
        out: list[int] = []
        data = self.rest + chunk
        special = self.tokenizer.special
        at = 0
        if special:
            # An added token may begin in the last characters and be longer than another that stands there already.
            certain = len(data) if last else len(data) - max(map(len, self.tokenizer.added)) + 1
            while (found := special.search(data, at)) and found.start() < certain:
                self._scan(data[at : found.start()], True, out)
                out.append(self.tokenizer.added[found.group()])
                at = found.end()
            held = len(data) if last else max(at, certain)
        else:
            held = len(data)
        rest = self._scan(data[at:held], last, out)
        self.rest = rest + data[held:]
        return out

    def finish(self) -> list[int]:
        return self.feed("", True)

    def _scan(self, data: str, last: bool, out: list[int]) -> str:
        """Emits the pieces of ``data`` that are certain; returns the characters that are not yet taken."""
        if self.run:
            data = self._go_on(data, last, out)
            if self.run or not data:
                return data
        shown = _as_unicode_16(data)
        found = PIECES.findall(shown)
        if shown is not data:
            ends = list(itertools.accumulate(map(len, found)))
            found = [data[a:b] for a, b in zip([0, *ends], ends)]
        rest = ""
        if not last and found:
            # The last piece may go on, and an apostrophe needs two characters more.
            rest = found.pop()
            while found and len(rest) + len(found[-1]) < 3:
                rest = found.pop() + rest
        out.extend(itertools.chain.from_iterable(map(self.tokenizer.pieces.__getitem__, found)))
        if len(rest) > CHUNK // 2:
            self.run = next(name for name, kind in RUNS.items() if kind.fullmatch(_as_unicode_16(rest[-1])))
            keep = 1 if self.run == "blanks" else 0
            out += self.window.feed(rest[: len(rest) - keep].encode())
            rest = rest[len(rest) - keep :]
        return rest

    def _go_on(self, data: str, last: bool, out: list[int]) -> str:
        """Passes on what belongs to the long piece; the last of several blanks belongs to what follows them."""
        end = RUNS[self.run].match(_as_unicode_16(data)).end()
        if end < len(data) or last:
            if self.run == "blanks" and end < len(data):
                end -= 1
            out += self.window.feed(data[:end].encode()) + self.window.close()
            self.run = None
            return data[end:]
        keep = 1 if self.run == "blanks" and data else 0
        out += self.window.feed(data[: end - keep].encode())
        return data[end - keep :]


def encode_text(tokenizer: Tokenizer, text: str, chunk: int = CHUNK) -> list[int]:
    encoder = Encoder(tokenizer)
    if len(text) <= chunk:
        return encoder.feed(text, True)
    out: list[int] = []
    for at in range(0, len(text), chunk):
        out += encoder.feed(text[at : at + chunk])
    return out + encoder.finish()


def decode_ids(tokenizer: Tokenizer, ids: np.ndarray | list[int], chunk: int = CHUNK) -> str:
    utf8 = codecs.getincrementaldecoder("utf-8")("replace")
    known = tokenizer.bytes
    out = []
    for at in range(0, len(ids), chunk):
        out.append(utf8.decode(b"".join([known.get(i, b"") for i in np.asarray(ids[at : at + chunk]).tolist()])))
    return "".join(out) + utf8.decode(b"", True)


@functools.lru_cache(maxsize=2)
def _tokenizer(spec: bytes) -> Tokenizer:
    """Built once in a worker, with its table of pieces."""
    return Tokenizer(json.loads(spec))


class Coder:
    """Encoding and decoding as column functions.

    The vocabulary file is read by the driver and sent to the tasks, so executors need no copy; its size is checked.
    """

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            spec = file.read(MOST_FILE_BYTES + 1)
        if len(spec) > MOST_FILE_BYTES:
            raise ValueError(f"{path} is above {MOST_FILE_BYTES} bytes")
        _tokenizer(spec)
        sent = spark.sparkContext.broadcast(spec)

        @F.arrow_udf("array<int>")
        def encoded(texts: pa.Array) -> pa.Array:
            tokenizer = _tokenizer(sent.value)
            flat, counts = [], []
            for text in texts:
                ids = encode_text(tokenizer, text.as_py() or "")
                flat.append(np.array(ids, np.int32))
                counts.append(len(ids))
            return ar.list_array(np.concatenate([*flat, np.zeros(0, np.int32)]), np.array(counts, np.int64), pa.int32())

        @F.arrow_udf("string")
        def decoded(ids: pa.Array) -> pa.Array:
            tokenizer = _tokenizer(sent.value)
            # A NULL id is one that the vocabulary lacks.
            flat = ids.flatten().fill_null(NO_TOKEN).to_numpy(zero_copy_only=False)
            ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
            return pa.array([decode_ids(tokenizer, flat[a:b]) for a, b in zip([0, *ends], ends)], pa.string())

        self._encoded, self._decoded = encoded, decoded

    def encode(self, text: Column) -> Column:
        """Token ids of a text, as array<int>."""
        return self._encoded(text)

    def decode(self, ids: Column) -> Column:
        """The text that these ids stand for."""
        # An expression of the JVM between two Python functions: chained directly, the inner one would run for each of its uses.
        return self._decoded(F.coalesce(ids, F.array().cast("array<int>")))
