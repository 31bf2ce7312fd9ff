"""Byte-level BPE as a bounded-lookahead streaming transducer.

A text is read in blocks. A pretoken longer than the window is itself streamed:
the merge list bounds how far to the right a token boundary can depend on the
text (``MergeList.lookahead``), so tokens that end further than that before the
end of the window are final and leave it. Decoding turns tokens into text through
an incremental UTF-8 decoder.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from tillscope.session import ship_package

# The pretoken pattern of byte-level BPE.
_PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# In these ranges the letter and digit classes do not depend on the Unicode
# version; other text is cut by the library's own pretokeniser.
_UNSETTLED = regex.compile(r"[^\u0000-ԯ぀-ヿ一-鿪가-힣]")
_BLOCK_CHARS = 1 << 16
_CACHED_BYTES = 64
_CACHE_ENTRIES = 500_000


def byte_names() -> dict[str, int]:
    """The printable name of each byte: itself if printable, else from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in plain}
    names.update({chr(0x100 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return names


class MergeList:
    """Vocabulary and merges of a ``tokenizer.json`` file with byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        names = byte_names()
        model = described["model"]
        ids = model["vocab"]

        def raw(token: str) -> bytes:
            return bytes(names[c] for c in token)

        self.bytes_of: dict[int, bytes] = {i: raw(token) for token, i in ids.items()}
        self.byte_ids = [0] * 256
        for name, b in names.items():
            self.byte_ids[b] = ids[name]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.rules: list[tuple[int, int, int]] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            rule = ids[a], ids[b], ids[a + b]
            self.rules.append(rule)
            self.merges.setdefault(rule[:2], (rank, rule[2]))
        self.added = {t["content"]: t["id"] for t in described["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.longest = max(map(len, self.bytes_of.values()))
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        """Bytes to the right that a token boundary can depend on, at most.

        Two texts with a common front part merge it alike until something differs
        at the end of that part. A difference moves left only through a merge
        (x, t) that happens in one text alone: it was possible or not because of
        the token t at the border. Behind it the border lies before x, and the
        next merge that can move it further left is one of higher rank whose right
        side is x or has grown from x. So the merges of a chain rise in rank, and
        the longest chain is found from the last merge to the first.
        """
        lefts: dict[int, set[int]] = {}
        for a, _, made in self.rules:
            lefts.setdefault(made, set()).add(a)
        reach: dict[int, int] = {}
        furthest = 0
        for a, b, _ in reversed(self.rules):
            shift = len(self.bytes_of[a]) + reach.get(a, 0)
            furthest = max(furthest, shift)
            spine, todo = {b}, [b]
            while todo:
                for left in lefts.get(todo.pop(), ()):
                    if left not in spine:
                        spine.add(left)
                        todo.append(left)
            for token in spine:
                reach[token] = max(reach.get(token, 0), shift)
        return furthest + self.longest

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of a piece: always the pair of lowest rank, leftmost first."""
        tokens = [self.byte_ids[b] for b in piece]
        merges = self.merges
        if len(tokens) <= 64:
            none = (len(self.rules), -1)
            found = [merges.get(pair, none) for pair in zip(tokens, tokens[1:])]
            while found:
                best = min(found)
                if best is none:
                    break
                at = found.index(best)
                tokens[at : at + 2] = [best[1]]
                del found[at]
                if at:
                    found[at - 1] = merges.get((tokens[at - 1], best[1]), none)
                if at < len(found):
                    found[at] = merges.get((best[1], tokens[at + 1]), none)
            return tokens
        after = [*range(1, len(tokens)), -1]
        ahead = [*range(-1, len(tokens) - 1)]
        alive = [True] * len(tokens)
        queue = [
            (merges[pair][0], at, *pair)
            for at, pair in enumerate(zip(tokens, tokens[1:]))
            if pair in merges
        ]
        heapq.heapify(queue)
        while queue:
            _, at, a, b = heapq.heappop(queue)
            nxt = after[at]
            if not alive[at] or nxt < 0 or tokens[at] != a or tokens[nxt] != b:
                continue
            tokens[at] = merges[a, b][1]
            alive[nxt] = False
            after[at] = after[nxt]
            if after[at] >= 0:
                ahead[after[at]] = at
            for left in (ahead[at], at):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (tokens[left], tokens[right]) in merges:
                    rank = merges[tokens[left], tokens[right]][0]
                    heapq.heappush(queue, (rank, left, tokens[left], tokens[right]))
        return [t for t, live in zip(tokens, alive) if live]

    def stream(self, piece: bytes, block: int = 1024) -> Iterator[list[int]]:
        """Tokens of a piece of any length, from a window of bounded size."""
        block = max(block, self.longest)
        start = 0
        while start < len(piece):
            window = piece[start : start + block + self.lookahead]
            tokens = self.merge(window)
            if start + len(window) >= len(piece):
                yield tokens
                return
            done, stable = 0, 0
            while done + len(self.bytes_of[tokens[stable]]) <= block:
                done += len(self.bytes_of[tokens[stable]])
                stable += 1
            yield tokens[:stable]
            start += done


def _packed(tokens: list[int]) -> bytes:
    return struct.pack(f"<{len(tokens)}I", *tokens)


class _Known(dict):
    """Token bytes by pretoken; unknown ones are merged on demand."""

    def __init__(self, merges: MergeList) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, pretoken: str) -> bytes:
        piece = pretoken.encode("utf-8", "surrogatepass")
        if len(piece) > _CACHED_BYTES:
            return b"".join(map(_packed, self.merges.stream(piece)))
        if len(self) >= _CACHE_ENTRIES:
            self.clear()
        self[pretoken] = found = _packed(self.merges.merge(piece))
        return found


class Transducer:
    """Text to token ids and back, block by block.

    Token ids are blocks of little-endian unsigned 32-bit integers. The working
    state is one block, one window and a cache of bounded size.
    """

    def __init__(self, path: str) -> None:
        self.merges = MergeList(path)
        self.known = _Known(self.merges)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        contents = sorted(map(regex.escape, self.merges.added), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(contents)})") if contents else None

    def _pretokens(self, block: str) -> list[str]:
        if _UNSETTLED.search(block) is None:
            return _PRETOKEN.findall(block)
        return [block[a:b] for _, (a, b) in self.library.pre_tokenize_str(block)]

    def _plain(self, text: str) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = at + _BLOCK_CHARS
            if end < len(text):
                # Between a visible character and white space a pretoken always ends.
                cut = regex.compile(r"(?<=\S)(?=\s)").search(text, end)
                end = cut.start() if cut else len(text)
            block = text if at == 0 and end >= len(text) else text[at:end]
            yield b"".join(map(self.known.__getitem__, self._pretokens(block)))
            at = end

    def encode(self, text: str, added: bool = True) -> Iterator[bytes]:
        """Token ids; strings of added tokens become those tokens if ``added``."""
        if not added or self.special is None or self.special.search(text) is None:
            yield from self._plain(text)
            return
        for n, part in enumerate(self.special.split(text)):
            if n % 2:
                yield self.merges.added[part].to_bytes(4, "little")
            else:
                yield from self._plain(part)

    def decode(self, blocks: Iterator[bytes]) -> Iterator[str]:
        """Text of a token stream; bytes that are no UTF-8 become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        of = self.merges.bytes_of
        for block in blocks:
            yield state.decode(b"".join(map(of.__getitem__, memoryview(block).cast("I"))))
        yield state.decode(b"", True)


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a file, loaded once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def transduce(docs: DataFrame, path: str, ids: bool = False, decoded: bool = False) -> DataFrame:
    """Encode and decode every whole text of ``docs(doc_id, text)``.

    Returns doc_id, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers) and ``decoded_sha256`` (of the decoded text in
    UTF-8); on request also the ids themselves (``ids``, binary in that form) and
    the text (``decoded``). A null text counts as empty: no tokens, empty text.
    Repeated rows and null ids stay; other columns are dropped. ``path`` is a
    tokenizer file that every executor can read.
    """
    ship_package(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            *[T.StructField("ids", T.BinaryType())] * ids,
            *[T.StructField("decoded", T.StringType())] * decoded,
        ]
    )

    def one(text: str | None) -> tuple:
        coder = transducer(path)
        taken, spoken = hashlib.sha256(), hashlib.sha256()
        kept_ids: list[bytes] = []
        kept_text: list[str] = []
        count = 0

        def watched() -> Iterator[bytes]:
            nonlocal count
            for block in coder.encode(text or ""):
                count += len(block) // 4
                taken.update(block)
                if ids:
                    kept_ids.append(block)
                yield block

        for part in coder.decode(watched()):
            spoken.update(part.encode())
            if decoded:
                kept_text.append(part)
        row = (count, taken.hexdigest(), spoken.hexdigest())
        return row + (b"".join(kept_ids),) * ids + ("".join(kept_text),) * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Small slices keep the output of long texts small.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [one(t.as_py()) for t in part.column("text")]
                columns = list(zip(*rows)) if rows else [()] * (len(schema) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, columns)], schema.names
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, schema
    )
