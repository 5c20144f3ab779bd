"""Slow plain-Python references for one series (NaN = missing)."""

import numpy as np

nan = np.nan


def over(x, d, fn):
    out = np.full(len(x), nan)
    for i in range(d - 1, len(x)):
        out[i] = fn(x[i - d + 1:i + 1])
    return out


def present(w):
    return w[~np.isnan(w)]


def mean(w):
    v = present(w)
    return v.mean() if len(v) else nan


def std(w):
    v = present(w)
    return v.std(ddof=1) if len(v) > 1 else nan


def rank(w):
    if np.isnan(w[-1]):
        return nan
    v = present(w)
    return (np.sum(v < w[-1]) + 1) / len(v)


def argmax(w):
    if not len(present(w)):
        return nan
    return len(w) - 1 - int(np.nanargmax(w))


def argmin(w):
    if not len(present(w)):
        return nan
    return len(w) - 1 - int(np.nanargmin(w))


def decay(w):
    k = np.arange(1, len(w) + 1.0)
    ok = ~np.isnan(w)
    return (w[ok] * k[ok]).sum() / k[ok].sum() if ok.any() else nan


def quantile(p):
    def fn(w):
        v = np.sort(present(w))
        return v[int(min(max(np.ceil(p * len(v)) - 1, 0), len(v) - 1))] if len(v) else nan
    return fn


def skew(w):
    v = present(w)
    n = len(v)
    if n < 3 or v.std() <= 1e-10:
        return nan
    z = (v - v.mean()) / v.std()
    return (z ** 3).mean() * np.sqrt(n * (n - 1)) / (n - 2)


def kurt(w):
    v = present(w)
    n = len(v)
    if n < 4 or v.std() <= 1e-10:
        return nan
    z = (v - v.mean()) / v.std()
    return ((n + 1) * ((z ** 4).mean() - 3) + 6) * (n - 1) / ((n - 2) * (n - 3))


def trend(w, part):
    d = len(w)
    if np.isnan(w[-1]) or len(present(w)) < 3:
        return nan
    t = np.arange(d)[~np.isnan(w)]
    b, a = np.polyfit(t, present(w), 1)
    fit = a + b * (d - 1)
    if part == "rsq":
        sst = ((present(w) - present(w).mean()) ** 2).sum()
        return 1 - ((present(w) - a - b * t) ** 2).sum() / sst if sst > 1e-10 else 0.0
    return {"slope": b, "intercept": a, "predict": fit, "resid": w[-1] - fit}[part]


def hump(w):
    d = len(w)
    if len(present(w)) < 3:
        return nan
    at, top = int(np.nanargmax(w)), np.nanmax(w)
    ok = int(d * .3) <= at <= int(d * .7) and top > w[0] and top > w[-1]
    return 1.0 if ok else 0.0


def smooth(x, a, b, seed_rows, start=0, seed="mean"):
    out = np.full(len(x), nan)
    s = nan
    for i in range(start + seed_rows - 1, len(x)):
        if i == start + seed_rows - 1:
            w = x[start:i + 1]
            s = w.mean() if seed == "mean" else w.sum()
        else:
            s = a * s + b * x[i]
        out[i] = s
    return out


def ema(x, p, start=0):
    k = 2 / (p + 1)
    return smooth(x, 1 - k, k, p, start)


def wilder(x, p, start=0):
    return smooth(x, (p - 1) / p, 1 / p, p, start)


def shift(x, k=1):
    return np.concatenate([np.full(k, nan), x[:-k]])


def true_range(h, l, c):
    p = shift(c)
    return np.where(np.isnan(p), nan, np.fmax(h - l, np.fmax(abs(h - p), abs(l - p))))


def rsi(c, p):
    d = c - shift(c)
    g, l = wilder(np.where(np.isnan(d), nan, np.maximum(d, 0)), p, 1), wilder(
        np.where(np.isnan(d), nan, np.maximum(-d, 0)), p, 1)
    return (100 * g / (g + l) - 50) / 50


def adx(h, l, c, p):
    n = len(c)
    up, dn = h - shift(h), shift(l) - l
    plus = np.where((up > 0) & (up > dn), up, 0.0)
    minus = np.where((dn > 0) & (dn > up), dn, 0.0)
    tr = true_range(h, l, c)
    sp, sm, st = plus[1:p].sum(), minus[1:p].sum(), tr[1:p].sum()
    dx, out = [], np.full(n, nan)
    for i in range(p, n):
        sp, sm, st = sp - sp / p + plus[i], sm - sm / p + minus[i], st - st / p + tr[i]
        pdi, mdi = 100 * sp / st, 100 * sm / st
        dx.append(100 * abs(pdi - mdi) / (pdi + mdi))
        if len(dx) == p:
            out[i] = np.mean(dx)
        elif len(dx) > p:
            out[i] = (out[i - 1] * (p - 1) + dx[-1]) / p
    return out


def macd(c, f, s, g):
    dif = ema(c, f, s - f) - ema(c, s)
    return 2 * (dif - ema(dif, g, s - 1))


def kama(x, p):
    out = np.full(len(x), nan)
    prev = x[p - 1]
    for i in range(p, len(x)):
        move, path = abs(x[i] - x[i - p]), abs(np.diff(x[i - p:i + 1])).sum()
        er = 1 if path <= move or path == 0 else move / path
        prev += (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (x[i] - prev)
        out[i] = prev
    return out


def ar_resid(x, p):
    d, out = 3 * p + 5, np.full(len(x), nan)
    for i in range(d + p - 1, len(x)):
        rows = [[1] + [x[t - k] for k in range(1, p + 1)] for t in range(i - d + 1, i + 1)]
        coef = np.linalg.lstsq(np.array(rows), x[i - d + 1:i + 1], rcond=None)[0]
        out[i] = x[i] - np.array(rows[-1]) @ coef
    return out
