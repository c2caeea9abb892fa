"""Offset-preserving SentencePiece encoding (byte-pair models) and decoding.

The model file is read here, without the library: pieces, scores, and the
compiled character map, a double-array trie of source strings with their
normalised forms. Normalisation takes the longest source string in the map at
each place and records, for every byte it writes, the source byte it came from.
Merging runs on the normalised text; every piece is then projected through that
record onto the original text, as a span of UTF-8 bytes.

A piece never has a word separator after another character (this is checked
when the model is read), so no merge crosses from a word into the separator that
follows it. Text is therefore cut there, each distinct cut is merged once, and a
bounded table keeps its ids and lengths.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import blocks, documents, list_array, per_batch

SEP = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Distinct cuts that a worker keeps at most, twice (a young and an old table).
CACHE = 100_000
#: Characters coded at once, about.
BATCH_CHARS = 1_000_000
#: Longer cuts are merged with a heap.
SHORT = 40
#: The score of a pair that no piece joins.
NEVER = float("-inf")


def fields(buf: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """The (number, value) pairs of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(buf):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, buf[i : i + n]
            i += n
        elif key & 7 == 5:
            yield key >> 3, struct.unpack_from("<f", buf, i)[0]
            i += 4
        else:
            yield key >> 3, buf[i : i + 8]
            i += 8


class CharMap:
    """The compiled character map: longest-prefix replacement of byte strings."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
        self.forms = blob[4 + n :]
        self.starts = {b for b in range(256) if self._step(self._offset(self.units[0]), b) is not None}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, at: int, byte: int) -> int | None:
        at ^= byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, text: bytes, i: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest mapped string at ``i``, if any."""
        at, found = self._offset(self.units[0]), None
        for j in range(i, len(text)):
            if (node := self._step(at, text[j])) is None:
                break
            at = node ^ self._offset(self.units[node])
            if self.units[node] >> 8 & 1:
                found = j + 1 - i, self.units[at] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.forms[found[1] : self.forms.index(b"\0", found[1])]


class Cuts(dict):
    """Cut -> its ids and piece lengths by turns, as bytes. Forgets what was not used lately once CACHE is reached."""

    def __init__(self, one, many):
        super().__init__()
        self.one, self.many, self.old = one, many, {}

    def __missing__(self, cut: str) -> bytes:
        out = self.old.get(cut) or self.one(cut)
        if len(cut) < 100:
            self[cut] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def prepare(self, cuts: set[str]) -> None:
        """Take in the cuts not known yet, together. Makes room first."""
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
        old = self.old
        self.update(self.many([c for c in cuts if c not in self and c not in old]))


class Codec:
    """A byte-pair SentencePiece model, read from its serialised form."""

    def __init__(self, model: bytes):
        pieces, trainer, norm = [], {}, {}
        for k, v in fields(model):
            if k == 1:
                pieces.append(dict(fields(v)))
            elif k == 2:
                trainer = dict(fields(v))
            elif k == 3:
                norm = dict(fields(v))
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != 2 or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.get(24) or not norm.get(5, 1):
            raise ValueError("only byte-pair models of normal, unknown, control and byte pieces with escaped separators as prefixes are read")
        names = [p[1].decode() for p in pieces]
        if any(b == SEP != a for n, k in zip(names, kinds) if k == NORMAL for a, b in zip(n, n[1:])):
            raise ValueError("a piece has a separator within a word")
        self.names, self.kinds = names, kinds
        self.ids = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k == NORMAL}
        self.scores = {n: pieces[i].get(2, 0.0) for n, i in self.ids.items()}
        self.unk = kinds.index(UNKNOWN)
        self.bytes = [self.names.index(f"<0x{b:02X}>") for b in range(256)] if BYTE in kinds else None
        self.fallback = bool(trainer.get(35)) and self.bytes is not None
        self.unk_surface = trainer.get(44, " ⁇ ".encode())
        self.charmap = CharMap(norm[2]) if norm.get(2) else None
        self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.plain = self.charmap is None and not self.squeeze
        self.forms = np.array([self._form(i) for i in range(len(names))], object)
        self.silent = np.array([k == CONTROL for k in kinds])
        self._tables()
        alone = "".join(c for c in "\n\t" if not any(c in n for n in self.ids))  # in no piece, so never merged
        blank = SEP if not self.plain else f" {SEP}"
        self._cut = re.compile(f"[{blank}]*[^{blank}{alone}]+|[{blank}]+" + f"|[{alone}]" * bool(alone))
        self.cuts = Cuts(self._plain_cut if self.plain else self._norm_cut, self._many)

    # ---- normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, separators escaped, and for each of its bytes (and its end) the byte of the source where it begins."""
        src, out, at = text.encode(), bytearray(), []
        sep, i, n = SEP.encode(), 0, len(src)
        if n == 0:
            return "", np.zeros(1, np.int32)

        def one(i: int) -> tuple[int, bytes]:
            if self.charmap is not None and src[i] in self.charmap.starts and (got := self.charmap.longest(src, i)):
                return got
            k = 1 if src[i] < 0x80 else 2 if src[i] < 0xE0 else 3 if src[i] < 0xF0 else 4
            return k, src[i : i + k]

        if self.squeeze:  # white space at the start goes
            while i < n and (got := one(i))[1] == b" ":
                i += got[0]
            if i == n:
                return "", np.full(1, n, np.int32)
        if self.prefix:
            out += sep
            at += [i] * 3
        blank = self.squeeze
        while i < n:
            k, form = one(i)
            while blank and form[:1] == b" ":
                form = form[1:]
            if form:
                for b in form:
                    new = sep if b == 32 else bytes((b,))
                    out += new
                    at += [i] * len(new)
                blank = self.squeeze and form[-1:] == b" "
            i += k
        end = n
        while self.squeeze and out[-3:] == sep:
            if len(out) < 3:
                break
            end = at[-3]
            del out[-3:], at[-3:]
        return out.decode(), np.array([*at, end], np.int32)

    # ---- merging

    def merge(self, cut: str) -> list[str]:
        """The pieces of a cut of normalised text: best score first, then the leftmost."""
        scores, parts = self.scores, list(cut)
        if len(parts) > SHORT:
            return self._merge_long(parts)
        worth = [scores.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while worth and (best := max(worth)) != NEVER:
            i = worth.index(best)
            parts[i : i + 2] = [both := parts[i] + parts[i + 1]]
            del worth[i]
            if i:
                worth[i - 1] = scores.get(parts[i - 1] + both, NEVER)
            if i < len(worth):
                worth[i] = scores.get(both + parts[i + 1], NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        scores, n = self.scores, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (w := scores.get(both := parts[i] + parts[j])) is not None:
                heap.append((-w, i, both)) if not ready else heapq.heappush(heap, (-w, i, both))

        ready = False
        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def _tables(self) -> None:
        """Arrays for merging many cuts at once: symbols of characters, and the pairs of symbols that a piece joins, with its symbol."""
        order = sorted(self.ids, key=lambda n: (-self.scores[n], self.ids[n]))
        rank = {n: i for i, n in enumerate(order)}
        self.symbol = np.full(0x110000, -1, np.int32)
        for n in order:
            if len(n) == 1:
                self.symbol[ord(n)] = rank[n]
        self.symbol[32] = self.symbol[ord(SEP)]
        found = [(rank[n[:k]] * len(order) + rank[n[k:]], rank[n]) for n in order for k in range(1, len(n)) if n[:k] in rank and n[k:] in rank]
        found.sort()
        self.pair_keys, self.pair_rank = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        self.rank_id = np.array([self.ids[n] for n in order], np.int32)
        steps = np.cumsum([0] + [self.scores[a] != self.scores[b] for a, b in zip(order, order[1:])])
        self.priority = np.append(steps, len(order)).astype(np.int32)  # of each symbol, the lower first; equal scores are equal
        self.batchable = bool(found) and SEP in rank  # else a cut at a time

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbol of the piece that joins two symbols; the number of symbols if none does."""
        n = len(self.rank_id)
        key = a.astype(np.int64) * n + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], n).astype(np.int32)

    def _many(self, cuts: list[str]) -> dict[str, bytes]:
        """Merge many short cuts of known characters, in rounds: each round joins the best pair of every cut. The rest: one by one."""
        cuts.sort(key=len)  # cuts of like length are merged together
        n_short = sum(len(c) <= SHORT for c in cuts) if self.batchable else 0
        out = {c: self.cuts.one(c) for c in cuts[n_short:] if len(c) < 100}
        for a in range(0, n_short, 8192):
            part = cuts[a : min(a + 8192, n_short)]
            size = np.array([*map(len, part)])
            points = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
            place = np.arange(size[-1])[None, :] < size[:, None]
            sym, width = np.full(place.shape, -1, np.int32), np.zeros(place.shape, np.int32)
            sym[place] = self.symbol[points]
            width[place] = np.where((points == 32) & (not self.plain), 3, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
            strange = (place & (sym < 0)).any(1)
            out.update((c, self.cuts.one(c)) for c, x in zip(part, strange.tolist()) if x)
            self._rounds(sym, width, size)
            live = np.arange(sym.shape[1])[None, :] < size[:, None]
            live[strange] = False
            both = np.stack([self.rank_id[sym[live]], width[live]], 1).tobytes()
            stops = (np.cumsum(live.sum(1)) * 8).tolist()
            out.update((c, both[i:j]) for c, i, j, x in zip(part, [0, *stops], stops, strange.tolist()) if not x)
        return out

    def _rounds(self, sym: np.ndarray, width: np.ndarray, size: np.ndarray) -> None:
        """Join symbols in place until no piece joins two neighbours; ``size`` becomes the number of pieces."""
        none = len(self.rank_id)
        rows = np.arange(len(sym))
        prior = self.priority
        worth = prior[self._joined(sym[:, :-1], sym[:, 1:])] if sym.shape[1] > 1 else np.full((len(sym), 1), none, np.int32)
        places = np.arange(sym.shape[1])
        while len(rows):
            best = worth.argmin(1)
            more = worth[np.arange(len(rows)), best] < none
            rows, best, worth = rows[more], best[more], worth[more]
            if not len(rows):
                return
            here, each = np.arange(len(rows)), sym[rows]
            gain = self._joined(each[here, best], each[here, best + 1])
            w = width[rows]
            w[here, best] += w[here, best + 1]
            each[here, best] = gain
            shift = np.minimum(places[None, :] + (places[None, :] > best[:, None]), len(places) - 1)
            each, w = np.take_along_axis(each, shift, 1), np.take_along_axis(w, shift, 1)
            each[:, -1], w[:, -1] = -1, 0
            worth = np.take_along_axis(worth, np.minimum(shift[:, :-1], worth.shape[1] - 1), 1)
            worth[:, -1] = none
            left = best > 0
            worth[here[left], best[left] - 1] = prior[self._joined(each[here[left], best[left] - 1], gain[left])]
            right = best + 1 < each.shape[1]
            worth[here[right], best[right]] = prior[self._joined(gain[right], each[here[right], best[right] + 1])]
            sym[rows], width[rows] = each, w
            size[rows] -= 1

    def _number(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Ids and normalised byte lengths. Of the bytes of an unknown piece the last has the whole length."""
        ids, sizes = [], []
        for p in pieces:
            if (i := self.ids.get(p)) is not None or not self.fallback:
                ids.append(self.unk if i is None else i)
                sizes.append(len(p) if p.isascii() else len(p.encode()))
            else:
                raw = p.encode()
                ids += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
        return ids, sizes

    def _norm_cut(self, cut: str) -> bytes:
        ids, sizes = self._number(self.merge(cut))
        return array("i", [x for pair in zip(ids, sizes) for x in pair]).tobytes()

    def _plain_cut(self, cut: str, lead: str = "") -> bytes:
        """A cut of source text: a blank is one byte there and three when normalised. ``lead``: the added separator."""
        pieces = self.merge(lead + cut.replace(" ", SEP))
        ids, sizes = self._number(pieces)
        if not lead and cut[0] == " " and sizes[0] and " " not in cut[1:]:
            sizes[0] -= 2
        elif " " in cut or lead:
            k = 0
            done = -len(lead)
            for p in pieces:
                n = len(p.encode()) - 2 * sum(cut[j] == " " for j in range(max(done, 0), done + len(p))) - 3 * (done < 0)
                done += len(p)
                while sizes[k] == 0:
                    k += 1
                sizes[k] = n
                k += 1
        return array("i", [x for pair in zip(ids, sizes) for x in pair]).tobytes()

    # ---- whole texts

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): each piece and the bytes of ``text`` that it stands for."""
        return next(self.encode_all([text]))

    def encode_all(self, some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of each of a few texts; their new cuts are merged together."""
        plain = self.plain
        forms = [(t, None) for t in some] if plain else [self.normalise(t) for t in some]
        cuts = [self._cut.findall(t) for t, _ in forms]
        self.cuts.prepare(set().union(*cuts))
        for c, (_, at) in zip(cuts, forms):
            raw = b"".join(map(self.cuts.__getitem__, c[1:] if plain and self.prefix else c))
            if plain and self.prefix and c:
                raw = self._plain_cut(c[0], SEP) + raw
            ids, sizes = np.ascontiguousarray(np.frombuffer(raw, np.int32).reshape(-1, 2).T)
            ends = np.cumsum(sizes, dtype=np.int32)
            yield (ids, ends - sizes, ends) if plain else (ids, at[ends - sizes], at[ends])

    # ---- decoding

    def _form(self, i: int) -> bytes:
        kind, name = self.kinds[i], self.names[i]
        if kind == BYTE:
            return bytes((int(name[3:5], 16),))
        return b"" if kind == CONTROL else self.unk_surface if kind == UNKNOWN else name.replace(SEP, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``. Bytes that are no UTF-8 become U+FFFD, one for each."""
        forms = self.forms[ids].tolist()
        if (self.prefix or self.squeeze) and forms:
            seen, k = False, 0
            while k < len(forms):  # the first separator goes, if nothing is before it
                kind = self.kinds[ids[k]]
                if kind == BYTE or kind == UNKNOWN or (kind == NORMAL and seen):
                    break
                if kind == NORMAL:
                    lead = forms[k][:1] == b" "
                    forms[k] = forms[k][lead:]
                    seen = lead and not self.squeeze
                    if forms[k] or seen:
                        break
                k += 1
        raw = b"".join(forms)
        if not self.silent[ids].any():
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        return self._decode_runs(ids, forms)

    def _decode_runs(self, ids: np.ndarray, forms: list[bytes]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + k]).decode())
                        i += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for i, form in zip(ids.tolist(), forms):
            if self.kinds[i] == BYTE:
                run += form
            else:
                flush()
                out.append(form.decode())
        flush()
        return "".join(out)


@lru_cache(2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def encode(df: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` of each row with ids, begins and ends: the pieces of its whole text and their spans in UTF-8 bytes.

    ``decoded``: also the text that ``decode`` makes of the ids, in the same pass.
    Null and empty texts have no pieces. Other columns are left out. The model
    (half a megabyte) travels with the tasks; texts are coded a few at a time and
    leave in batches of bounded size, so a very long text costs its own length.
    Rows that repeat are coded each; an empty table gives an empty one.
    """
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).alias("text"))
    kinds = "".join(f"k{i} {df.select(k).schema[0].dataType.simpleString()}, " for i, k in enumerate(keep))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        codec = _codec(model)
        for first, some in blocks(batch, BATCH_CHARS):
            done = [*codec.encode_all(some)]
            cols = {f"k{i}": batch.column(f"k{i}").slice(first, len(some)) for i in range(len(keep))}
            sizes = [len(d[0]) for d in done]
            for j, name in enumerate(("ids", "begins", "ends")):
                cols[name] = list_array(np.concatenate([d[j] for d in done]).astype(np.int32, copy=False), sizes)
            if decoded:
                cols["decoded"] = [codec.decode(d[0]) for d in done]
            yield cols

    out = per_batch(rows, run, kinds + "ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decoded, lambda: _codec(model).cuts.forget())
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "ids", "begins", "ends", *["decoded"] * decoded)


def decode(df: DataFrame, model: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids in column ``to``. Null is decoded as no ids."""
    rest = [c for c in df.columns if c != to]
    body = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.coalesce(F.col(ids), F.array()).cast("array<int>").alias("ids"))
    kind = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(rest)] + [T.StructField("decoded", T.StringType())])

    def run(batch: pa.RecordBatch) -> dict:
        codec, column = _codec(model), batch.column("ids")
        flat, at = column.values.to_numpy(), column.offsets.to_numpy()
        out = [codec.decode(flat[a:b]) for a, b in zip(at, at[1:])]
        return {f"c{i}": batch.column(f"c{i}") for i in range(len(rest))} | {"decoded": out}

    return per_batch(body, run, kind).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("decoded").alias(to))


def public_model(name: str = "piece_bpe_32k.model") -> bytes:
    """The bytes of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def with_digests(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to ``keep``, n_tokens and the digests of ids and decoded text, and how many bytes of the text the spans cover."""
    return df.select(
        "doc_id",
        *keep,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0), lambda a, b: a + b), F.lit(0)).cast("bigint").alias("n_bytes"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with spans and decoded again, as digests."""
    model = public_model()
    return with_digests(encode(documents(spark, sf_dir), model, decoded=True))
