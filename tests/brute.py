"""Plain-Python counterparts of the score and filling rules, for small fixtures."""

import hashlib
import math


def uniform(*parts):
    digest = hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()
    return int(digest[:8], 16) / 2**32


def softmax(logits):
    top = max(logits.values())
    shares = {t: math.exp(x - top) for t, x in logits.items()}
    total = sum(shares.values())
    return {t: e / total for t, e in shares.items()}


def by_share(probs):
    return sorted(probs.items(), key=lambda item: (-item[1], item[0]))


def nucleus(probs, top_p):
    kept, used = {}, 0.0
    for token, p in by_share(probs):
        if kept and round(used, 12) > top_p:
            break
        kept[token] = p
        used += p
    total = sum(kept.values())
    return {t: p / total for t, p in kept.items()}


def alias_cells(probs):
    """[(token, accept, alias)] in token order, made one after the other with a work list."""
    tokens = sorted(probs)
    fill = {t: round(probs[t] * len(tokens), 12) for t in tokens}
    accept, alias = {t: min(w, 1.0) for t, w in fill.items()}, {t: t for t in tokens}
    heavy = [t for t in tokens if fill[t] > 1]
    left = fill[heavy[0]] if heavy else 1.0
    for light in [t for t in tokens if fill[t] <= 1]:
        if not heavy:
            break
        alias[light] = heavy[0]
        left = round(left - (1 - fill[light]), 12)
        while left < 1 and len(heavy) > 1:
            accept[heavy[0]], alias[heavy[0]] = left, heavy[1]
            left = round(fill[heavy[1]] - (1 - left), 12)
            heavy.pop(0)
    return [(t, accept[t], alias[t]) for t in tokens]


def draw(probs, u):
    used = 0.0
    for token, p in by_share(probs):
        used += p
        if u < round(used, 12):
            return token, p
    raise AssertionError("shares do not reach 1")


def alias_draw(probs, u):
    cells = alias_cells(probs)
    place = u * len(cells)
    token, accept, alias = cells[int(place)]
    token = token if place - int(place) < accept else alias
    return token, probs[token]


def candidate(table, ctx, cfg, u):
    """(token, share) for a context; the distribution -1 serves unknown contexts."""
    logits = table.get(ctx) or table[-1]
    if cfg.temperature <= 0:
        probs = softmax(logits)
        token = min(logits, key=lambda t: (-logits[t], t))
        return token, probs[token]
    probs = softmax({t: x / cfg.temperature for t, x in logits.items()})
    return alias_draw(nucleus(probs, cfg.top_p), u)


def complete_eos(slots, cfg):
    for i, token in enumerate(slots):
        if token == cfg.mask_id:
            return None
        if token == cfg.eos_id:
            return i
    return None


def fill(last_tokens, scores, suppressed, cfg):
    """{seq: (tokens, steps)}; every sequence is stopped on its own."""
    table = {}
    for ctx, token, logit in scores:
        if token not in suppressed:
            table.setdefault(ctx, {})[token] = logit
    slots = {s: [] for s in last_tokens}
    when = {s: [] for s in last_tokens}
    finished, done, step = set(), 0, 0
    while done < cfg.max_new_tokens:
        length = min(cfg.block_size, cfg.max_new_tokens - done)
        active = [s for s in slots if s not in finished]
        if not active:
            break
        for s in active:
            slots[s] += [cfg.mask_id] * length
            when[s] += [None] * length
        for _ in range(4 * length):
            for start in range(0, length, cfg.sub_block_size):
                for s in active:
                    x = slots[s]
                    places = range(done + start, done + min(start + cfg.sub_block_size, length))
                    found = {}
                    for i in places:
                        ctx = x[i - 1] if i else last_tokens[s]
                        if x[i] == cfg.mask_id and s not in finished:
                            found[i] = candidate(table, ctx, cfg, uniform(cfg.seed, step, s, i))
                    if found:
                        best = min(found, key=lambda i: (-round(found[i][1], 12), i))
                        for i, (token, p) in found.items():
                            if i == best or round(p, 12) > cfg.threshold:
                                x[i], when[s][i] = token, step
                step += 1
            for s in active:
                if complete_eos(slots[s], cfg) is not None:
                    finished.add(s)
            if all(s in finished or cfg.mask_id not in slots[s] for s in active):
                break
        done += length
    out = {}
    for s, x in slots.items():
        end = complete_eos(x, cfg)
        end = len(x) if end is None else end + 1
        out[s] = (x[:end], when[s][:end])
    return out


def permuted(x, n, *parts):
    """The seeded bijection of 0 .. n - 1: rounds on a grid, until the number is below n again."""
    a = 1
    while a < 4096 and a * a < n:
        a *= 2
    b = -(-n // a)

    def shift(k, half, size):
        key = ":".join(str(p) for p in (*parts, k, half))
        return int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % size

    while True:
        r, c = x % a, x // a
        for k in range(6):
            if k % 2 == 0:
                c = (c + shift(k, r, b)) % b
            else:
                r = (r + shift(k, c, a)) % a
        x = c * a + r
        if x < n:
            return x
