"""NumPy kernels on one raster tile: pixels in, arrays or small record lists out.

Masks are boolean with True for ink. Kernels know nothing of Spark; ``tiles`` runs them in Arrow batches.
"""

from __future__ import annotations

import numpy as np

LUMA = np.array([0.2125, 0.7154, 0.0721])


def to_grey(rgb: np.ndarray) -> np.ndarray:
    """uint8 RGB to 0..1."""
    return rgb[..., :3].astype(np.float64) @ LUMA / 255.0


def box_sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sum over the (2r+1)^2 window, reflecting at the border, by integral image."""
    p = np.pad(a.astype(np.float64), r, mode="reflect" if min(a.shape) > r else "edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * r + 1
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]


def sauvola(grey: np.ndarray, window: int = 25, k: float = 0.2, spread: float = 0.5) -> np.ndarray:
    """Ink where grey < m * (1 + k * (s / spread - 1))."""
    r, n = window // 2, (2 * (window // 2) + 1) ** 2
    m = box_sum(grey, r) / n
    s = np.sqrt(np.maximum(box_sum(grey * grey, r) / n - m * m, 0))
    return grey < m * (1 + k * (s / spread - 1))


def otsu(grey: np.ndarray, bins: int = 256) -> float:
    """Threshold with the largest variance between classes."""
    hist, edges = np.histogram(grey, bins=bins)
    mid = (edges[:-1] + edges[1:]) / 2
    w0 = hist.cumsum()
    w1 = hist.sum() - w0
    s0 = (hist * mid).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2
    return float(mid[np.nanargmax(between)]) if hist.sum() else 0.0


def denoise_means(grey: np.ndarray, sigma: float | None = None, patch: int = 5, reach: int = 11) -> np.ndarray:
    """Non-local means with h = sigma clamped to 0.02..0.08; sigma defaults to a median estimate of the noise."""
    if sigma is None:
        d = (grey[:-1, :-1] - grey[1:, :-1] - grey[:-1, 1:] + grey[1:, 1:]) / 2
        sigma = float(np.median(np.abs(d)) / 0.6745) if d.size else 0.0
    h = min(max(sigma, 0.02), 0.08)
    r, n = patch // 2, patch * patch
    total, weight = np.zeros_like(grey), np.zeros_like(grey)
    padded = np.pad(grey, reach, mode="reflect" if min(grey.shape) > reach else "edge")
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            shifted = padded[reach + dy : reach + dy + grey.shape[0], reach + dx : reach + dx + grey.shape[1]]
            w = np.exp(-np.maximum(box_sum((grey - shifted) ** 2, r) / n - 2 * sigma**2, 0) / h**2)
            total += w * shifted
            weight += w
    return total / weight


def shift(mask: np.ndarray, dy: int, dx: int, fill=False) -> np.ndarray:
    out = np.full_like(mask, fill)
    h, w = mask.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = mask[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def disk(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def dilate(mask: np.ndarray, r: int = 1) -> np.ndarray:
    return np.logical_or.reduce([shift(mask, dy, dx) for dy, dx in disk(r)])


def erode(mask: np.ndarray, r: int = 1) -> np.ndarray:
    return np.logical_and.reduce([shift(mask, dy, dx, True) for dy, dx in disk(r)])


def opening(mask: np.ndarray, r: int = 1) -> np.ndarray:
    return dilate(erode(mask, r), r)


def closing(mask: np.ndarray, r: int = 1) -> np.ndarray:
    return erode(dilate(mask, r), r)


def edge_of(mask: np.ndarray, r: int = 1) -> np.ndarray:
    return dilate(mask, r) & ~erode(mask, r)


def runs(mask: np.ndarray) -> np.ndarray:
    """(y, x0, x1) of the horizontal ink runs, x1 exclusive."""
    p = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    d = np.diff(p, axis=1)
    y, x0 = np.nonzero(d == 1)
    _, x1 = np.nonzero(d == -1)
    return np.stack([y, x0, x1], 1) if len(y) else np.zeros((0, 3), np.int64)


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components from 1 in row-major order of their first pixel, by union-find over runs."""
    r = runs(mask)
    parent = list(range(len(r)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    start = np.searchsorted(r[:, 0], np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = start[y - 1], start[y]
        while i < start[y] and j < start[y + 1]:
            if r[i, 1] <= r[j, 2] and r[j, 1] <= r[i, 2]:  # touching, corners included
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if r[i, 2] < r[j, 2]:
                i += 1
            else:
                j += 1
    out, names = np.zeros(mask.shape, np.int64), {}
    for k, (y, x0, x1) in enumerate(r):
        out[y, x0:x1] = names.setdefault(find(k), len(names) + 1)
    return out, len(names)


def convex_hull_area(ys: np.ndarray, xs: np.ndarray) -> float:
    """Area of the hull of the pixels' corners."""
    pts = sorted({(int(x) + dx, int(y) + dy) for y, x in zip(ys, xs) for dx in (0, 1) for dy in (0, 1)})
    if len(pts) < 3:
        return 0.0

    def half(points):
        out: list[tuple[int, int]] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(pts) + half(pts[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1]))) / 2


def perimeter_of(part: np.ndarray) -> float:
    """Length along the centres of border pixels: straight steps 1, diagonal ones sqrt 2, mixed corners their mean."""
    p = np.pad(part, 1)
    border = p & ~(shift(p, 0, 1) & shift(p, 0, -1) & shift(p, 1, 0) & shift(p, -1, 0))
    straight = sum(shift(border, *d).astype(int) for d in ((0, 1), (0, -1), (1, 0), (-1, 0)))
    diagonal = sum(shift(border, *d).astype(int) for d in ((1, 1), (1, -1), (-1, 1), (-1, -1)))
    code = (1 + 2 * straight + 10 * diagonal)[border]
    one = np.isin(code, (5, 7, 15, 17, 25, 27)).sum()
    root = np.isin(code, (21, 33)).sum()
    mixed = np.isin(code, (13, 23)).sum()
    return float(one + root * np.sqrt(2) + mixed * (1 + np.sqrt(2)) / 2)


def euler_of(part: np.ndarray) -> int:
    """Components less holes, 8-connected, from 2x2 windows."""
    p = np.pad(part, 1).astype(int)
    q = p[:-1, :-1] + p[:-1, 1:] + p[1:, :-1] + p[1:, 1:]
    two_diagonal = ((p[:-1, :-1] == p[1:, 1:]) & (p[:-1, 1:] == p[1:, :-1]) & (q == 2)).sum()
    return int(((q == 1).sum() - (q == 3).sum() - 2 * two_diagonal) // 4)


def region_table(labels: np.ndarray, count: int) -> list[dict]:
    """Measured properties of each component."""
    out = []
    order = np.argsort(labels, axis=None, kind="stable")
    flat = labels.ravel()[order]
    cuts = np.searchsorted(flat, np.arange(1, count + 2))
    for k in range(count):
        where = order[cuts[k] : cuts[k + 1]]
        ys, xs = np.divmod(where, labels.shape[1])
        y0, x0, y1, x1 = int(ys.min()), int(xs.min()), int(ys.max()) + 1, int(xs.max()) + 1
        part = np.zeros((y1 - y0, x1 - x0), bool)
        part[ys - y0, xs - x0] = True
        cy, cx, n = ys.mean(), xs.mean(), len(ys)
        myy, mxx, mxy = ((ys - cy) ** 2).mean() + 1 / 12, ((xs - cx) ** 2).mean() + 1 / 12, ((ys - cy) * (xs - cx)).mean()
        root = np.sqrt(((mxx - myy) / 2) ** 2 + mxy**2)
        big, small = (mxx + myy) / 2 + root, (mxx + myy) / 2 - root
        edge = np.zeros_like(part)
        edge |= part & ~(shift(part, 0, 1) & shift(part, 0, -1) & shift(part, 1, 0) & shift(part, -1, 0))
        ey, ex = np.nonzero(edge)
        hull = convex_hull_area(ey, ex)
        out.append(
            {
                "label": k + 1, "area": n, "y0": y0, "x0": x0, "y1": y1, "x1": x1, "cy": float(cy), "cx": float(cx), "perimeter": perimeter_of(part),
                "solidity": n / hull if hull else 1.0, "eccentricity": float(np.sqrt(max(0.0, 1 - small / big))) if big > 0 else 0.0, "euler": euler_of(part), "extent": n / part.size,
            }
        )
    return out


def run_measures(ys: np.ndarray, x0: np.ndarray, x1: np.ndarray, cells: int = 1 << 20) -> dict:
    """perimeter, solidity, eccentricity and euler of one component from its runs, drawn a band of about ``cells`` pixels at a time."""
    order = np.argsort(ys, kind="stable")
    ys, x0, x1 = (np.asarray(a, np.int64)[order] for a in (ys, x0, x1))
    top, left, height, width = ys[0], x0.min(), int(ys[-1] - ys[0] + 1), int(x1.max() - x0.min())
    ys, x0, x1 = ys - top, x0 - left, x1 - left
    size = x1 - x0
    n = int(size.sum())
    my, mx = ys - (ys * size).sum() / n, (x0 + x1 - 1) / 2 - ((x0 + x1 - 1) * size).sum() / (2 * n)
    myy, mxx, mxy = (size * my**2).sum() / n + 1 / 12, (size * mx**2 + size * (size**2 - 1) / 12).sum() / n + 1 / 12, (size * my * mx).sum() / n
    root = np.sqrt(((mxx - myy) / 2) ** 2 + mxy**2)
    big, small = (mxx + myy) / 2 + root, (mxx + myy) / 2 - root
    rows, at = np.unique(ys, return_index=True)
    hull = convex_hull_area(np.concatenate([rows, rows]), np.concatenate([np.minimum.reduceat(x0, at), np.maximum.reduceat(x1, at) - 1]))
    step = max(1, cells // (width + 4))
    codes, fours = np.zeros(50, np.int64), 0
    for a in range(0, height + 1, step):  # the row below the last closes its 2x2 windows
        b = min(a + step, height + 1)
        p = np.zeros((b - a + 4, width + 4), bool)  # two rows and columns about the band
        lo, hi = np.searchsorted(ys, [a - 2, b + 2])
        for y, s, e in zip(ys[lo:hi] - a + 2, x0[lo:hi] + 2, x1[lo:hi] + 2):
            p[y, s:e] = True
        c, f = border_codes(p, 2)
        codes, fours = codes + c, fours + f
    count = lambda *which: codes[list(which)].sum()
    length = count(5, 7, 15, 17, 25, 27) + count(21, 33) * np.sqrt(2) + count(13, 23) * (1 + np.sqrt(2)) / 2
    return {
        "perimeter": float(length), "solidity": n / hull if hull else 1.0,
        "eccentricity": float(np.sqrt(max(0.0, 1 - small / big))) if big > 0 else 0.0, "euler": int(fours // 4),
    }


def border_codes(p: np.ndarray, halo: int) -> tuple[np.ndarray, int]:
    """Counts of the border codes of ``perimeter_of`` and four times the Euler number's share, for the rows within the halo."""
    border = p & ~(shift(p, 0, 1) & shift(p, 0, -1) & shift(p, 1, 0) & shift(p, -1, 0))
    straight = sum(shift(border, *d).astype(np.int8) for d in ((0, 1), (0, -1), (1, 0), (-1, 0)))
    diagonal = sum(shift(border, *d).astype(np.int8) for d in ((1, 1), (1, -1), (-1, 1), (-1, -1)))
    code = (1 + 2 * straight + 10 * diagonal)[halo:-halo][border[halo:-halo]]
    w = p[halo - 1 : -halo].astype(np.int8)
    q = w[:-1, :-1] + w[:-1, 1:] + w[1:, :-1] + w[1:, 1:]
    two = ((w[:-1, :-1] == w[1:, 1:]) & (w[:-1, 1:] == w[1:, :-1]) & (q == 2)).sum()
    return np.bincount(code, minlength=50)[:50], int((q == 1).sum() - (q == 3).sum() - 2 * two)


def hu_moments(part: np.ndarray) -> np.ndarray:
    """Seven log-scaled invariant moments of a boolean shape."""
    ys, xs = np.nonzero(part)
    if not len(ys):
        return np.zeros(7)
    y, x, n = ys - ys.mean(), xs - xs.mean(), len(ys)
    eta = lambda p, q: (x**p * y**q).sum() / n ** (1 + (p + q) / 2)
    n20, n02, n11, n30, n03, n21, n12 = eta(2, 0), eta(0, 2), eta(1, 1), eta(3, 0), eta(0, 3), eta(2, 1), eta(1, 2)
    a, b, c, d = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    h = np.array(
        [
            n20 + n02,
            (n20 - n02) ** 2 + 4 * n11**2,
            c * c + d * d,
            a * a + b * b,
            c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
            (n20 - n02) * (a * a - b * b) + 4 * n11 * a * b,
            d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
        ]
    )
    return -np.sign(h) * np.log10(np.maximum(np.abs(h), 1e-30))


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    p = np.pad(a.astype(np.float64), r, mode="reflect" if min(a.shape) > r else "edge")
    p = sum(w * p[i : i + a.shape[0], :] for i, w in enumerate(k))
    return sum(w * p[:, i : i + a.shape[1]] for i, w in enumerate(k))


def local_density(mask: np.ndarray, regions: list[dict], sigma: float = 8.0) -> list[float]:
    """Mean of the smoothed ink in a box of two sigma about each centre."""
    d, r = gaussian(mask, sigma), int(2 * sigma)
    h, w = mask.shape
    out = []
    for g in regions:
        cy, cx = int(g["cy"]), int(g["cx"])
        out.append(float(d[max(0, cy - r) : min(h, cy + r), max(0, cx - r) : min(w, cx + r)].mean()))
    return out


def sobel(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(grey, 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return gx, gy


def gradient_angle(grey: np.ndarray) -> np.ndarray:
    gx, gy = sobel(grey)
    return np.degrees(np.arctan2(gy, gx))


def canny(grey: np.ndarray, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> np.ndarray:
    """Edges by smoothing, thinning along the gradient and hysteresis."""
    gx, gy = sobel(gaussian(grey, sigma))
    mag = np.hypot(gx, gy)
    sector = np.round(np.degrees(np.arctan2(gy, gx)) / 45).astype(int) % 4
    p = np.pad(mag, 1)
    at = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    thin = np.zeros(mag.shape, bool)
    for s, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        thin |= (sector == s) & (mag >= at(dy, dx)) & (mag > at(-dy, -dx))
    weak, strong = thin & (mag >= low), thin & (mag >= high)
    labels, n = label(weak)
    keep = np.zeros(n + 1, bool)
    keep[np.unique(labels[strong])] = True
    keep[0] = False
    return keep[labels]


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Thinning in two alternating passes until nothing changes."""
    m = np.pad(mask, 1)
    while True:
        before = m.sum()
        for odd in (0, 1):
            n = [shift(m, *d) for d in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            north, _, east, _, south, _, west, _ = n
            neighbours = sum(x.astype(int) for x in n)
            turns = sum((~n[i] & n[(i + 1) % 8]).astype(int) for i in range(8))
            clear = ~(north & east & south) & ~(east & south & west) if odd == 0 else ~(north & east & west) & ~(north & south & west)
            m = m & ~(m & (neighbours >= 2) & (neighbours <= 6) & (turns == 1) & clear)
        if m.sum() == before:
            return m[1:-1, 1:-1]


def resize_nearest(a: np.ndarray, h: int, w: int) -> np.ndarray:
    return a[(np.arange(h) * a.shape[0] // h)[:, None], (np.arange(w) * a.shape[1] // w)[None, :]]


def rotate(a: np.ndarray, degrees: float, nearest: bool = True, fill=0) -> np.ndarray:
    """a turned about its centre by inverse mapping; what comes from outside is ``fill``."""
    h, w = a.shape[:2]
    t, cy, cx = np.radians(degrees), (h - 1) / 2, (w - 1) / 2
    yy, xx = np.mgrid[:h, :w]
    sx, sy = np.cos(t) * (xx - cx) - np.sin(t) * (yy - cy) + cx, np.sin(t) * (xx - cx) + np.cos(t) * (yy - cy) + cy
    if nearest:
        iy, ix = np.rint(sy).astype(int), np.rint(sx).astype(int)
        ok = (iy >= 0) & (iy < h) & (ix >= 0) & (ix < w)
        out = np.full_like(a, fill)
        out[ok] = a[iy[ok], ix[ok]]
        return out
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    ok = (y0 >= 0) & (y0 < h - 1) & (x0 >= 0) & (x0 < w - 1)
    y0, x0 = np.clip(y0, 0, max(h - 2, 0)), np.clip(x0, 0, max(w - 2, 0))
    fy, fx = sy - y0, sx - x0
    if a.ndim == 3:
        fy, fx, ok = fy[..., None], fx[..., None], ok[..., None]
    v = a.astype(np.float64)
    mix = v[y0, x0] * (1 - fy) * (1 - fx) + v[y0, x0 + 1] * (1 - fy) * fx + v[y0 + 1, x0] * fy * (1 - fx) + v[y0 + 1, x0 + 1] * fy * fx
    return np.where(ok, np.rint(mix) if a.dtype.kind == "u" else mix, fill).astype(a.dtype)


def hough_lines(mask: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Votes (angle, rho) of the ink for lines x cos + y sin = rho."""
    ys, xs = np.nonzero(mask)
    reach = int(np.hypot(*mask.shape)) + 1
    votes = np.zeros((len(angles), 2 * reach + 1), np.int64)
    for k, a in enumerate(np.radians(angles)):
        rho = np.rint(xs * np.cos(a) + ys * np.sin(a)).astype(int) + reach
        votes[k] = np.bincount(rho, minlength=2 * reach + 1)
    return votes


def skew_angle(mask: np.ndarray, limit: float = 5.0, step: float = 0.1, least: float = 0.20) -> float:
    """Tilt of near-horizontal lines in degrees: the weighted median over angles about the upright normal; 0 without a line of ``least`` of the width."""
    angles = 90 + np.arange(-limit, limit + step / 2, step)
    votes = hough_lines(mask, angles)
    best = votes.max(1)
    if not len(best) or best.max() < least * mask.shape[1]:
        return 0.0
    strong = best >= 0.9 * best.max()
    return float(np.round(np.median(angles[strong]) - 90, 3))


def ring(r: int, least: int = 36) -> tuple[np.ndarray, np.ndarray]:
    n = max(least, int(2 * np.pi * r))
    t = 2 * np.pi * np.arange(n) / n
    return np.rint(r * np.sin(t)).astype(int), np.rint(r * np.cos(t)).astype(int)


def hough_circles(mask: np.ndarray, radii: range, threshold: float = 0.6, peaks: int = 500) -> list[tuple[int, int, int, float]]:
    """(cy, cx, r, score) of local maxima: score is the share of the circumference that holds ink."""
    h, w = mask.shape
    ys, xs = np.nonzero(mask)
    found = []
    for r in radii:
        dy, dx = ring(r)
        seen = np.unique(np.stack([dy, dx], 1), axis=0)
        votes = np.zeros((h, w))
        for oy, ox in seen:
            cy, cx = ys + oy, xs + ox
            ok = (cy >= 0) & (cy < h) & (cx >= 0) & (cx < w)
            np.add.at(votes, (cy[ok], cx[ok]), 1)
        votes /= len(seen)
        top = votes >= threshold
        for d in disk(2):
            top &= votes >= shift(votes, *d, fill=0)
        found += [(int(y), int(x), r, float(votes[y, x])) for y, x in zip(*np.nonzero(top))]
    return sorted(found, key=lambda f: (-f[3], f))[:peaks]


def ncc(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every place where the template fits ('valid'), by FFT and integral images."""
    t = template.astype(np.float64) - template.mean()
    th, tw = t.shape
    h, w = image.shape
    if h < th or w < tw:
        return np.zeros((0, 0))
    a = image.astype(np.float64)
    f = np.fft.irfft2(np.fft.rfft2(a, (h, w)) * np.conj(np.fft.rfft2(t, (h, w))), (h, w))[: h - th + 1, : w - tw + 1]

    def sums(z):
        s = np.pad(z.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return s[th:, tw:] - s[:-th, tw:] - s[th:, :-tw] + s[:-th, :-tw]

    var = sums(a * a) - sums(a) ** 2 / (th * tw)
    scale = np.sqrt(np.maximum(var, 0) * (t * t).sum())
    return np.where(scale > 1e-9, f / np.maximum(scale, 1e-9), 0.0)


def peaks(score: np.ndarray, threshold: float, distance: int) -> list[tuple[int, int, float]]:
    """(y, x, score) of maxima in their neighbourhood, ties by row-major order, highest first."""
    ys, xs = np.nonzero(score >= threshold)
    order = np.lexsort((xs, ys, -score[ys, xs]))
    kept: list[tuple[int, int, float]] = []
    blocked = np.zeros(score.shape, bool)
    for k in order:
        y, x = int(ys[k]), int(xs[k])
        if not blocked[y, x]:
            kept.append((y, x, float(score[y, x])))
            blocked[max(0, y - distance) : y + distance + 1, max(0, x - distance) : x + distance + 1] = True
    return kept


def line_segments(mask: np.ndarray, least: int = 30, gap: int = 3, step: float = 1.0, votes: int = 20) -> list[tuple[int, int, int, int]]:
    """Straight segments (x0, y0, x1, y1): strongest line first, its ink taken out, until no line has the votes."""
    left, out = mask.copy(), []
    angles = np.arange(0, 180, step)
    while left.any() and len(out) < 1000:
        table = hough_lines(left, angles)
        k, rho = np.unravel_index(int(table.argmax()), table.shape)
        if table[k, rho] < votes:
            break
        reach, a = (table.shape[1] - 1) // 2, np.radians(angles[k])
        ys, xs = np.nonzero(left)
        on = np.abs(xs * np.cos(a) + ys * np.sin(a) - (rho - reach)) <= 1
        along = -xs[on] * np.sin(a) + ys[on] * np.cos(a)
        order = np.argsort(along)
        px, py, s = xs[on][order], ys[on][order], along[order]
        cuts = [0, *(np.nonzero(np.diff(s) > gap)[0] + 1), len(s)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if s[j - 1] - s[i] >= least:
                out.append((int(px[i]), int(py[i]), int(px[j - 1]), int(py[j - 1])))
        left[ys[on], xs[on]] = False
    return out


def open_v(width: int, height: int | None = None, stroke: int = 2, dot: bool = False) -> np.ndarray:
    """Template of an open V upside down (apex on top), with a dot below its base if asked."""
    height = height or round(width * 1.2)
    out = np.zeros((height, width), bool)
    for y in range(height):
        half = (width / 2 - 1) * y / max(1, height - 1)
        for side in (-1, 1):
            x = int(round(width / 2 - 0.5 + side * half))
            out[y, max(0, x - stroke // 2) : min(width, x + (stroke + 1) // 2)] = True
    if dot:
        out = np.pad(out, ((0, 5), (0, 0)))
        out[-3:, width // 2 - 1 : width // 2 + 2] = True
    return out


def star(size: int, arms: int = 8, stroke: int = 1) -> np.ndarray:
    out = np.zeros((size, size), bool)
    c = (size - 1) / 2
    for k in range(arms):
        t = 2 * np.pi * k / arms
        for r in np.arange(0, c + 0.25, 0.25):
            y, x = int(round(c + r * np.sin(t))), int(round(c + r * np.cos(t)))
            out[max(0, y) : y + stroke, max(0, x) : x + stroke] = True
    return out


def template_from_picture(grey: np.ndarray, heights: range = range(7, 15), ink_below: float = 200) -> dict[int, np.ndarray]:
    """Trimmed ink of a reference picture, scaled to each height."""
    ink = grey < ink_below
    ys, xs = np.nonzero(ink)
    if not len(ys):
        return {}
    cut = ink[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    return {h: resize_nearest(cut, h, max(1, round(cut.shape[1] * h / cut.shape[0]))) for h in heights}


def circles_by_bisectors(points: np.ndarray, radii: tuple[float, float], samples: int = 1000, min_chord: float = 8.0, seed: int = 42) -> np.ndarray:
    """(cx, cy, r) of circles through random point triplets of one component; all triplets if they are few."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3))
    if n * (n - 1) * (n - 2) // 6 <= samples:
        from itertools import combinations

        pick = np.array(list(combinations(range(n), 3)))
    else:
        pick = np.random.default_rng(seed).integers(0, n, (samples, 3))
    a, b, c = (points[pick[:, k]].astype(np.float64) for k in range(3))
    far = lambda p, q: np.hypot(*(p - q).T) >= min_chord
    u, v = b - a, c - a
    det = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    ok = far(a, b) & far(b, c) & far(a, c) & (np.abs(det) >= 1e-8)
    u, v, a, det = u[ok], v[ok], a[ok], det[ok]
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    ox, oy = (v[:, 1] * uu - u[:, 1] * vv) / det, (u[:, 0] * vv - v[:, 0] * uu) / det
    r = np.hypot(ox, oy)
    keep = (r >= radii[0]) & (r <= radii[1])
    return np.stack([a[keep, 0] + ox[keep], a[keep, 1] + oy[keep], r[keep]], 1)


def patch_for_text(grey: np.ndarray, scale: int = 3) -> np.ndarray:
    """Upscaled patch, dark on light."""
    big = np.repeat(np.repeat(grey, scale, 0), scale, 1)
    return 255 - big if big.mean() < 128 else big


def sharpen(grey: np.ndarray) -> np.ndarray:
    p = np.pad(grey.astype(np.float64), 1, mode="edge")
    out = 5 * p[1:-1, 1:-1] - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:]
    return np.clip(out, 0, 255).astype(np.uint8)


def upscale_long_edge(a: np.ndarray, edge: int = 3000) -> tuple[np.ndarray, float]:
    """Picture with its long edge at least ``edge`` pixels (cubic), and the factor; larger ones stay."""
    h, w = a.shape[:2]
    scale = edge / max(h, w)
    if scale <= 1:
        return a, 1.0

    def weights(n, m):
        at = (np.arange(m) + 0.5) * n / m - 0.5
        base = np.floor(at).astype(int)
        t = at - base
        k = lambda d: np.where(d <= 1, 1.25 * d**3 - 2.25 * d**2 + 1, -0.75 * (d**3 - 5 * d**2 + 8 * d - 4))
        return [(np.clip(base + j, 0, n - 1), k(np.abs(t - j))) for j in (-1, 0, 1, 2)]

    nh, nw = round(h * scale), round(w * scale)
    v = a.astype(np.float64)
    extra = (1,) * (a.ndim - 2)
    v = sum(v[i] * wt.reshape(-1, 1, *extra) for i, wt in weights(h, nh))
    v = sum(v[:, i] * wt.reshape(1, -1, *extra) for i, wt in weights(w, nw))
    return np.clip(np.rint(v), 0, 255).astype(a.dtype), scale


def peak_map(image: np.ndarray, templates: list[np.ndarray]) -> np.ndarray:
    """Pixel-wise best correlation over templates at their centres; -1 off the ink and where none fits."""
    best = np.full(image.shape, -1.0)
    for t in templates:
        s = ncc(image, t)
        if s.size:
            y, x = t.shape[0] // 2, t.shape[1] // 2
            view = best[y : y + s.shape[0], x : x + s.shape[1]]
            np.maximum(view, s, out=view)
    best[~image.astype(bool)] = -1.0
    return best
