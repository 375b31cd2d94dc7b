"""Media columns: progressive JPEG, written and read without an image library.

Reading accumulates the scans of a progressive file into coefficient arrays: spectral selection adds
bands, successive approximation adds bits. Then blocks are inverse-transformed in numpy, chroma is
upsampled, and the picture is a full-resolution RGB tensor. Any baseline-free Huffman progressive
file (SOF2, 8 bit, up to 4 components, restart intervals) can be read.

Writing serves payloads: bytes become quantised coefficients (quantisation 1), so they survive
exactly. The transform's input is never rounded, the coefficients are the stored unit. Luma is
sampled 2x2, so a macroblock holds 384 bytes. Coefficients are chosen such that every code has the
same length; then both directions of a scan are array operations.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from affinis.llm.common import mapped

UNIT = 192
MACRO = 384
# fixed values: the order in which a block's coefficients are coded
ZIGZAG = np.array(sorted(range(64), key=lambda i: ((i // 8 + i % 8), (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
SCALE = 15


def _basis() -> np.ndarray:
    """(coded coefficient, pixel) of the 8x8 inverse transform in integers, so that sums in float64
    are exact whatever their order: equal blocks give equal pixels on any machine."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(0.5), 1.0) / 2
    two = np.einsum("uy,vx->uvyx", c, c).reshape(64, 64)
    return np.rint(two[ZIGZAG] * (1 << SCALE))


BASIS = _basis()


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload): spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


# --- writing ------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, lengths: dict[int, int]) -> bytes:
    """DHT of symbols with their code lengths, in order."""
    counts = [sum(1 for v in lengths.values() if v == n) for n in range(1, 17)]
    return _segment(0xC4, bytes([kind << 4 | slot, *counts]) + bytes(sorted(lengths, key=lambda s: (lengths[s], s))))


def _scan(component: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, 0x00, first, last, high << 4 | low])) + data


def _stuffed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def _runs(n: int) -> list[int]:
    return [32767] * (n // 32767) + ([n % 32767] if n % 32767 else [])


def write(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are ``payload`` (a positive multiple of UNIT)."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes")
    macros = -(-len(payload) // MACRO)
    cols = -(-macros // 4095)
    rows = -(-macros // cols)
    body = payload + b" " * (rows * cols * MACRO - len(payload))
    grid = np.frombuffer(body, np.uint8).reshape(rows, cols, 6, 64)
    luma = grid[:, :, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = [luma, grid[:, :, 4].reshape(-1, 64), grid[:, :, 5].reshape(-1, 64)]
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # one symbol, one bit: DC differences of 7 bits, AC runs of none with 7 bits; and end-of-band runs
    out += [_table(0, 0, {7: 1}), _table(1, 0, {0x07: 1})]
    # DC: 256 + byte. A restart after every block sets the prediction to 0: one byte a block
    out.append(_segment(0xDD, struct.pack(">H", 1)))
    for c, p in enumerate(planes):
        dc = np.empty((len(p), 3), np.uint8)
        dc[:, 0] = 64 + (p[:, 0] >> 2)
        dc[:, 1] = 0xFF
        dc[:, 2] = 0xD0 + np.arange(len(p)) % 8
        out.append(_scan(c + 1, 0, 0, 0, 2, dc.tobytes()[:-2]))
    out.append(_segment(0xDD, struct.pack(">H", 0)))
    # AC: sign is the byte's top bit, magnitude 128 + its other bits. Without the last bit: 7 bits
    for first, last in ((1, 5), (6, 63)):
        for c, p in enumerate(planes):
            b = p[:, first : last + 1]
            half = 64 + ((b & 127) >> 1)
            out.append(_scan(c + 1, first, last, 0, 1, np.where(b & 128, half, 127 - half).astype(np.uint8).tobytes()))
    for high in (2, 1):
        for c, p in enumerate(planes):
            out.append(_scan(c + 1, 0, 0, high, high - 1, _stuffed(p[:, 0] >> (high - 1) & 1)))
    out.append(_table(1, 0, {r << 4: 4 for r in range(15)}))
    for c, p in enumerate(planes):
        bits, at = [], 0
        for n in _runs(len(p)):
            r = n.bit_length() - 1
            head = f"{r:04b}" + (f"{n - (1 << r):0{r}b}" if r else "")
            bits += [np.frombuffer(head.encode(), np.uint8) - 48, (p[at : at + n, 1:] & 1).ravel()]
            at += n
        out.append(_scan(c + 1, 1, 63, 1, 0, _stuffed(np.concatenate(bits))))
    return b"".join([*out, b"\xff\xd9"])


# --- reading ------------------------------------------------------------------------------------


class _Bits:
    """Bits of one restart interval, for scans that are not of constant stride."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        v = 0
        for n in range(1, 17):
            v = v << 1 | self.take(1)
            if (n, v) in codes:
                return codes[n, v]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Picture:
    """Coefficients of a progressive file: planes[c] is (block rows, block columns, 64), in coded order."""

    def __init__(self, data: bytes):
        self.comment = b""
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], dict] = {}
        self.interval = 0
        self.planes: list[np.ndarray] = []
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        at = 2
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xD9:
                return
            (n,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    k = sum(body[1:17])
                    self.tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + k])
                    body = body[17 + k :]
            elif marker == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                end = at
                while not (data[(end := data.index(b"\xff", end)) + 1] not in (0, *range(0xD0, 0xD8))):
                    end += 2
                self._scan(body, data[at:end])
                at = end
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only progressive Huffman files are read")

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or not self.height or not self.width:
            raise ValueError("8-bit frames of known size only")
        self.ids, self.sample, self.quant_of = [], [], []
        for i in range(n):
            c, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.ids.append(c)
            self.sample.append((hv & 15, hv >> 4))
            self.quant_of.append(q)
        self.most = max(v for v, _ in self.sample), max(h for _, h in self.sample)
        self.macro = -(-self.height // (8 * self.most[0])), -(-self.width // (8 * self.most[1]))
        self.planes = [np.zeros((self.macro[0] * v, self.macro[1] * h, 64), np.int16) for v, h in self.sample]

    def _blocks(self, c: int) -> tuple[int, int]:
        """Block rows and columns that a scan of this component alone codes."""
        v, h = self.sample[c]
        return -(-(-(-self.height * v // self.most[0])) // 8), -(-(-(-self.width * h // self.most[1])) // 8)

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        parts = [(self.ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        first, last, hl = body[1 + 2 * n : 4 + 2 * n]
        high, low = hl >> 4, hl & 15
        if n == 1:
            c, dc, ac = parts[0]
            rows, cols = self._blocks(c)
            own = self.planes[c][:rows, :cols]
            flat = np.ascontiguousarray(own).reshape(-1, 64)
            if self._whole(flat, data, self.tables.get((0, dc)) if not first else self.tables.get((1, ac)), first, last, high, low):
                own[...] = flat.reshape(rows, cols, 64)
                return
            order = [[(c, dc, ac, flat[i])] for i in range(len(flat))]
            self._entropy(order, data, first, last, high, low)
            own[...] = flat.reshape(rows, cols, 64)
            return
        order = []
        for r in range(self.macro[0]):
            for q in range(self.macro[1]):
                order.append([(c, dc, ac, self.planes[c][r * self.sample[c][0] + y, q * self.sample[c][1] + x]) for c, dc, ac in parts for y in range(self.sample[c][0]) for x in range(self.sample[c][1])])
        self._entropy(order, data, first, last, high, low)

    def _whole(self, flat: np.ndarray, data: bytes, codes: dict | None, first: int, last: int, high: int, low: int) -> bool:
        """A scan of constant stride, as one array operation. False: it is none."""
        n = len(flat)
        one = next(iter(codes.items())) if codes and len(codes) == 1 else None
        if not first and not high:
            if one != ((1, 0), 7) or self.interval != 1 or len(data) != 3 * n - 2:
                return False
            a = np.frombuffer(data + b"\xff\xd0", np.uint8).reshape(n, 3)
            if (a[:, 0] >= 128).any() or (a[:, 1] != 0xFF).any():
                return False
            flat[:, 0] = np.where(a[:, 0] & 64, a[:, 0], a[:, 0].astype(np.int16) - 127) << low
            return True
        if self.interval:
            return False
        if not first:
            bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
            flat[:, 0] |= bits[:n].astype(np.int16) << low
            return True
        wide = last - first + 1
        if not high:
            if one != ((1, 0), 7) or len(data) != n * wide:
                return False
            a = np.frombuffer(data, np.uint8).reshape(n, wide).astype(np.int16)
            if (a >= 128).any():
                return False
            flat[:, first : last + 1] = np.where(a & 64, a, a - 127) * (1 << low)
            return True
        band = flat[:, first : last + 1]
        if not (band != 0).all():
            return False
        # all coefficients have a history: the scan is end-of-band runs and one bit for each
        bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        head, at, done = _Bits(b""), 0, 0
        more = np.zeros((n, wide), np.int16)
        while done < n:
            head.bits, head.at = bits[at : at + 32].tolist(), 0
            s = head.symbol(codes or {})
            if s & 15 or s >> 4 == 15:
                return False
            run = (1 << (s >> 4)) + head.take(s >> 4)
            at += head.at
            if run > n - done or at + run * wide > len(bits):
                return False
            more[done : done + run] = bits[at : at + run * wide].reshape(run, wide)
            at, done = at + run * wide, done + run
        flat[:, first : last + 1] += np.sign(band) * (more << low)
        return True

    def _entropy(self, order: list, data: bytes, first: int, last: int, high: int, low: int) -> None:
        pieces, at = [], 0
        if self.interval:
            i = 0
            while (i := data.find(b"\xff", i)) >= 0:
                if 0xD0 <= data[i + 1] <= 0xD7:
                    pieces.append(data[at:i])
                    at = i + 2
                i += 2
        pieces.append(data[at:])
        size = self.interval or len(order)
        for k, piece in enumerate(pieces):
            bits, pred, run = _Bits(piece), {}, 0
            for unit in order[k * size : (k + 1) * size]:
                for c, dc, ac, block in unit:
                    if not first:
                        if high:
                            block[0] |= bits.take(1) << low
                        else:
                            pred[c] = pred.get(c, 0) + bits.signed(bits.symbol(self.tables[0, dc]))
                            block[0] = pred[c] << low
                    elif high:
                        run = self._refine(bits, self.tables[1, ac], block, first, last, low, run)
                    elif run:
                        run -= 1
                    else:
                        run = self._begin(bits, self.tables[1, ac], block, first, last, low)

    @staticmethod
    def _begin(bits: _Bits, codes: dict, block, first: int, last: int, low: int) -> int:
        k = first
        while k <= last:
            s = bits.symbol(codes)
            r, n = s >> 4, s & 15
            if n:
                k += r
                block[k] = bits.signed(n) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                return (1 << r) + bits.take(r) - 1
        return 0

    @staticmethod
    def _refine(bits: _Bits, codes: dict, block, first: int, last: int, low: int, run: int) -> int:
        def corrected(k):
            if bits.take(1):
                block[k] += (1 << low) if block[k] > 0 else -(1 << low)

        k = first
        if not run:
            while k <= last:
                s = bits.symbol(codes)
                r, n = s >> 4, s & 15
                new = 0
                if n:
                    new = (1 << low) if bits.take(1) else -(1 << low)
                elif r < 15:
                    run = (1 << r) + bits.take(r)
                    break
                while k <= last:
                    if block[k]:
                        corrected(k)
                    elif r:
                        r -= 1
                    else:
                        break
                    k += 1
                if new and k <= last:
                    block[k] = new
                k += 1
        if run:
            while k <= last:
                if block[k]:
                    corrected(k)
                k += 1
            run -= 1
        return run

    def rgb(self) -> np.ndarray:
        """(height, width, 3) uint8. One component gives grey, three are taken as luma and chroma."""
        full = []
        for c, p in enumerate(self.planes):
            r, q, _ = p.shape
            v = p.reshape(-1, 64) * self.quant[self.quant_of[c]]
            pix = (v.astype(np.float64) @ BASIS).astype(np.int32)
            pix = np.clip((pix + (1 << (SCALE - 1)) >> SCALE) + 128, 0, 255).astype(np.uint8)
            pix = pix.reshape(r, q, 8, 8).transpose(0, 2, 1, 3).reshape(8 * r, 8 * q)
            up = self.most[0] // self.sample[c][0], self.most[1] // self.sample[c][1]
            if up[0] > 1:
                pix = np.repeat(pix, up[0], axis=0)
            if up[1] > 1:
                pix = np.repeat(pix, up[1], axis=1)
            full.append(pix[: self.height, : self.width])
        if len(full) < 3:
            return np.repeat(full[0][:, :, None], 3, axis=2)
        y, cb, cr = full[0].astype(np.int32), full[1].astype(np.int32) - 128, full[2].astype(np.int32) - 128
        half = 1 << 15
        out = np.empty((self.height, self.width, 3), np.uint8)
        out[:, :, 0] = np.clip(y + (91881 * cr + half >> 16), 0, 255)
        out[:, :, 1] = np.clip(y - (22554 * cb + 46802 * cr + half >> 16), 0, 255)
        out[:, :, 2] = np.clip(y + (116130 * cb + half >> 16), 0, 255)
        return out

    def payload(self) -> bytes:
        """The bytes that ``write`` has stored."""
        rows, cols = self.macro
        coded = [np.empty(p.shape, np.uint8) for p in self.planes]
        for p, b in zip(self.planes, coded, strict=True):
            b[...] = (np.abs(p) & 127) | (p > 0) * np.uint8(128)
            b[:, :, 0] = p[:, :, 0] - 256
        grid = np.empty((rows, cols, 6, 64), np.uint8)
        grid[:, :, :4] = coded[0].reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, cols, 4, 64)
        grid[:, :, 4], grid[:, :, 5] = coded[1], coded[2]
        return grid.tobytes()[: int(self.comment.split()[1])]


def feature(rgb: np.ndarray) -> str:
    """Shape, rounded channel means and checksum of a tensor."""
    mean = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (rgb.shape[0] * rgb.shape[1])
    return f"{rgb.shape[0]}x{rgb.shape[1]}x3;mean={mean[0]},{mean[1]},{mean[2]};crc={zlib.crc32(rgb.tobytes()):08x}"


# --- columns ------------------------------------------------------------------------------------


def stored(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) plus n_bytes and media, the text's payload as a JPEG file.
    Null texts count as empty and give a payload of UNIT spaces."""

    def make():
        def work(texts):
            got = [padded(t) for t in texts]
            return [[n for n, _ in got], [write(p) for _, p in got]]

        return work

    return mapped(docs, text, docs.columns if keep is None else keep, "n_bytes long, media binary", make)


def opened(media: DataFrame, column: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) plus height, width and rgb (rows of pixels, 3 bytes each) of
    each progressive JPEG in ``column``; null where the file is null or not of that kind."""

    def make():
        def work(files):
            out = []
            for f in files:
                try:
                    t = Picture(bytes(f)).rgb() if f is not None else None
                except (ValueError, IndexError, KeyError, struct.error):
                    t = None
                out.append((None, None, None) if t is None else (t.shape[0], t.shape[1], t.tobytes()))
            return [list(x) for x in zip(*out, strict=True)] if out else [[], [], []]

        return work

    return mapped(media, column, media.columns if keep is None else keep, "height int, width int, rgb binary", make)


def digests(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Writes each text's file, reads it back and reduces both to figures, without keeping files or
    tensors as columns: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. Equal texts give equal values; null counts as empty."""

    def make():
        def work(texts):
            rows = []
            for t in texts:
                n, payload = padded(t)
                media = write(payload)
                del payload
                p = Picture(media)
                back = p.payload()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(p.rgb())))
            return [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 7

        return work

    return mapped(docs, text, docs.columns if keep is None else keep, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)
