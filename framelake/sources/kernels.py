"""Pixel kernels: one decoded photo (height x width x BGR, 8 bit) in, a few numbers out."""

from __future__ import annotations

import struct
import zlib

import numpy as np

EDGE, FALLBACK_EDGE = 640, 256
EMPTY_HASH = "0" * 16


def gray(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299]))


def shrink(img: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """Longest edge at most `edge`, by means over areas; never enlarged."""
    scale = edge / max(img.shape[:2])
    return img if scale >= 1 else resize(img, max(1, round(img.shape[0] * scale)), max(1, round(img.shape[1] * scale)))


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas that fall on each pixel (nearest pixels where the result is larger)."""
    for axis, n in ((0, height), (1, width)):
        size = img.shape[axis]
        if n == size:
            continue
        if n > size:
            img = np.take(img, np.arange(n) * size // n, axis)
            continue
        at = np.arange(n + 1) * size / n
        total = np.concatenate([np.zeros_like(np.take(img, [0], axis), float), np.cumsum(img, axis, dtype=float)], axis)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if a == axis else 1 for a in range(img.ndim)])
        reached = np.take(total, low, axis) * (1 - part) + np.take(total, np.minimum(low + 1, size), axis) * part
        img = np.diff(reached, axis=axis) / (size / n)
    return img


def equalised(g: np.ndarray) -> np.ndarray:
    """Histogram equalisation of an 8-bit image."""
    hist = np.bincount(g.astype(np.uint8).ravel(), minlength=256)
    total = np.cumsum(hist)
    first = total[np.argmax(hist > 0)]
    if total[-1] == first:
        return g
    return np.rint((total - first) / (total[-1] - first) * 255).clip(0, 255)[g.astype(np.uint8)]


def phash(bgr: np.ndarray) -> str:
    """64 bits of the low frequencies of a 32 x 32 cosine transform against their median, as 16 hexadecimal digits."""
    g = equalised(np.rint(gray(resize(bgr, 32, 32))))
    k, n = np.arange(8)[:, None], np.arange(32)[None]
    basis = np.cos(np.pi * k * (2 * n + 1) / 64)
    low = (basis @ g @ basis.T).ravel()
    bits = low > np.median(low[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def laplacian(g: np.ndarray) -> np.ndarray:
    """Four-neighbour second differences; the border mirrors without its own row."""
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def sharpness(bgr: np.ndarray) -> tuple[float, list[float]]:
    """Mean of the four sharpest of 4 x 4 cells (the centre ones count 1.15 times), and all cells."""
    lap = laplacian(gray(bgr))
    h, w = lap.shape
    if h < 4 or w < 4:
        return float(lap.var()), []
    ys, xs = [h // 4 * i for i in range(4)] + [h], [w // 4 * i for i in range(4)] + [w]
    cells = [float(lap[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].var()) * (1.15 if i in (1, 2) and j in (1, 2) else 1) for i in range(4) for j in range(4)]
    return float(np.mean(sorted(cells)[-4:])), cells


def region_sharpness(bgr: np.ndarray, x: int, y: int, w: int, h: int) -> float:
    """Variance of the Laplacian in a box, held to the image; 0 for an empty box."""
    height, width = bgr.shape[:2]
    x0, y0, x1, y1 = max(0, x), max(0, y), min(width, x + w), min(height, y + h)
    return float(laplacian(gray(bgr[y0:y1, x0:x1])).var()) if x1 > x0 and y1 > y0 else 0.0


def exposure(bgr: np.ndarray) -> tuple[float, list[int]]:
    """Score of the luma histogram, and the histogram scaled to 255."""
    hist = np.bincount(gray(bgr).astype(np.uint8).ravel(), minlength=256)
    clip = (hist[:6].sum() + hist[250:].sum()) / hist.sum()
    mean = float((hist * np.arange(256)).sum() / hist.sum())
    score = (1 - clip) * (1 - 0.15 * abs(mean - 127) / 127)
    return float(min(1.0, max(0.0, score))), np.rint(hist / hist.max() * 255).astype(int).tolist()


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue 0-179, saturation and value 0-255."""
    b, g, r = (bgr[..., i].astype(float) for i in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = v - low
    safe = np.where(d == 0, 1, d)
    hue = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    hue = np.where(d == 0, 0, hue % 360) / 2
    return np.stack([np.rint(hue) % 180, np.rint(np.where(v == 0, 0, d / np.where(v == 0, 1, v) * 255)), v], -1).astype(np.uint8)


def hsv_histogram(bgr: np.ndarray) -> list[float]:
    """692 bins of the centre half, over pixels that are colourful and bright enough; each of the three parts sums to 1 or 0."""
    h, w = bgr.shape[:2]
    img = hsv(bgr[h // 4 : h // 4 + max(1, h // 2), w // 4 : w // 4 + max(1, w // 2)])
    s, v = img[..., 1], img[..., 2]
    mask = (s > np.clip(0.25 * s.max(), 15, 60)) & (v > np.clip(0.20 * v.max(), 15, 45))
    parts = [np.bincount(img[..., i][mask], minlength=n)[:n] for i, n in enumerate((180, 256, 256))]
    return np.concatenate([p / max(1, p.sum()) for p in parts]).tolist()


_PATTERN = np.random.default_rng(256).integers(-12, 13, (256, 4))


def descriptors(bgr: np.ndarray, most: int = 256, margin: int = 14) -> list[bytes]:
    """Up to `most` corners as 256 brightness comparisons (32 bytes each), strongest first."""
    g = equalised(np.rint(gray(bgr)))
    if min(g.shape) <= 2 * margin:
        return []
    gy, gx = np.gradient(g)
    box = lambda a: resize_mean(a, 3)
    xx, yy, xy = box(gx * gx), box(gy * gy), box(gx * gy)
    corner = xx * yy - xy**2 - 0.04 * (xx + yy) ** 2
    inner = corner[margin:-margin, margin:-margin]
    top = np.argsort(-inner, axis=None, kind="stable")[:most]
    ys, xs = np.unravel_index(top[inner.ravel()[top] > 1e-6], inner.shape)
    smooth = resize_mean(g, 5)
    y, x = ys[:, None] + margin, xs[:, None] + margin
    bits = smooth[y + _PATTERN[:, 0], x + _PATTERN[:, 1]] < smooth[y + _PATTERN[:, 2], x + _PATTERN[:, 3]]
    return [r.tobytes() for r in np.packbits(bits, axis=1)]


def resize_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window of odd size, mirrored at the border."""
    r = size // 2
    p = np.pad(a, r, mode="reflect" if min(a.shape) > r else "edge")
    total = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / size**2


def _otsu(a: np.ndarray) -> int:
    hist = np.bincount(a.astype(np.uint8).ravel(), minlength=256).astype(float)
    w = np.cumsum(hist)
    mean = np.cumsum(hist * np.arange(256))
    between = (mean[-1] * w - mean * w[-1]) ** 2 / np.maximum(w * (w[-1] - w), 1e-9)
    return int(np.argmax(between))


def focus_mask(bgr: np.ndarray) -> np.ndarray:
    """Where a photo is in focus: strength of second differences at three scales, split at Otsu's threshold, then cleaned
    of specks and holes except beside strong edges."""
    scale = max(bgr.shape[:2]) / 960
    odd = lambda x: max(3, int(round(x)) | 1)
    g = gray(bgr)
    strength = sum(w * np.abs(laplacian(resize_mean(g, k))) for w, k in ((0.25, 1), (0.5, 3), (0.25, 5)))
    strength = resize_mean(strength, min(odd(9 * scale), min(g.shape) // 2 * 2 - 1 or 1))
    level = (strength - strength.min()) / max(1e-9, float(np.ptp(strength))) * 255
    raw = level > _otsu(level)
    grow = lambda m, k: resize_mean(m.astype(float), min(k, min(m.shape) // 2 * 2 - 1 or 1)) > 1e-9
    fade = lambda m, k: ~grow(~m, k)
    opened = grow(fade(raw, odd(7 * scale)), odd(7 * scale))
    closed = fade(grow(opened, odd(19 * scale)), odd(19 * scale))
    gy, gx = np.gradient(g)
    edges = grow(np.hypot(gx, gy) > 60, odd(3 * scale))
    return np.where(edges, raw, closed)


def mask_png(mask: np.ndarray) -> bytes:
    """A white image whose alpha channel is the mask."""
    h, w = mask.shape
    alpha = np.where(mask, 255, 0).astype(np.uint8)
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.stack([np.full((h, w), 255, np.uint8)] * 3 + [alpha], -1).reshape(h, 4 * w)], 1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def embedded_jpeg(raw: bytes, reach: int = 50 << 20) -> bytes:
    """The longest start-to-end span of a raw file's previews; each start goes with the first end after it. Else the file."""
    best, at = b"", raw.find(b"\xff\xd8")
    while at >= 0:
        end = raw.find(b"\xff\xd9", at + 2, at + reach)
        if end < 0:
            at = raw.find(b"\xff\xd8", at + 2)
            continue
        if end + 2 - at > len(best):
            best = raw[at : end + 2]
        at = raw.find(b"\xff\xd8", end + 2)
    return best or raw


EXIF_TAGS = {0x829D: "f_number", 0x829A: "shutter", 0x8827: "iso", 0x9003: "original", 0x9004: "digitized", 0x0132: "modified"}


def exif(content: bytes) -> dict[str, str | None]:
    """f_number, shutter, iso and time as text, from the first 256 KB; all null where there is no readable record."""
    found: dict[str, str] = {}
    head = content[: 256 << 10]
    at = head.find(b"Exif\0\0")
    tiff = head[at + 6 :] if at >= 0 else head
    try:
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]
        todo, seen = [struct.unpack(order + "I", tiff[4:8])[0]], set()
        while todo:
            start = todo.pop()
            if start in seen or start + 2 > len(tiff):
                continue
            seen.add(start)
            for i in range(struct.unpack_from(order + "H", tiff, start)[0]):
                tag, kind, count = struct.unpack_from(order + "HHI", tiff, start + 2 + 12 * i)
                value = start + 2 + 12 * i + 8
                if tag == 0x8769:
                    todo.append(struct.unpack_from(order + "I", tiff, value)[0])
                elif tag in EXIF_TAGS and EXIF_TAGS[tag] not in found:
                    size = {2: 1, 3: 2, 4: 4, 5: 8}.get(kind, 0) * count
                    place = value if size <= 4 else struct.unpack_from(order + "I", tiff, value)[0]
                    if kind == 2:
                        found[EXIF_TAGS[tag]] = tiff[place : place + count].split(b"\0")[0].decode("ascii", "replace")
                    elif kind == 5:
                        found[EXIF_TAGS[tag]] = "{}/{}".format(*struct.unpack_from(order + "II", tiff, place))
                    elif kind in (3, 4):
                        found[EXIF_TAGS[tag]] = str(struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, place)[0])
    except (KeyError, struct.error):
        pass
    time = found.get("original") or found.get("digitized") or found.get("modified")
    return {"f_number": found.get("f_number"), "shutter": found.get("shutter"), "iso": found.get("iso"), "time": time}
