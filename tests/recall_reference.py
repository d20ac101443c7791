"""The recall pipeline once more in plain Python over dictionaries, for small tables: what the plans must agree with."""

import heapq
import math
import re

import numpy as np


def usable(v, dim):
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    n = min(len(a), len(b))
    x, y = np.array(a[:n], dtype=float), np.array(b[:n], dtype=float)
    both = np.linalg.norm(x) * np.linalg.norm(y)
    return float(x @ y / both) if both > 0 else (float("nan") if math.isnan(both) else 0.0)


def best(scores, k, places=6):
    """The k best ids of a dict, scores rounded, ties by id."""
    return sorted(((e, round(s, places) + 0.0) for e, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]


def pooled(*lists):
    """Log-sum-exp of (id, score) lists by id."""
    held = {}
    for rows in lists:
        for e, s in rows:
            if s is not None and math.isfinite(s):
                held.setdefault(e, []).append(s)
    return {e: max(x) + math.log(sum(math.exp(s - max(x)) for s in x)) for e, x in held.items()}


def stems(text):
    out = []
    for t in re.split(r"[^\w]|_", (text or "").lower()):
        if not t:
            continue
        for s in ("ing", "edly", "ed", "ly", "ies", "es", "s"):
            if t.endswith(s):
                if len(t.encode()) > len(s) + 2:
                    t = t[: -len(s)]
                break
        out.append(t)
    return out


def bm25(docs, text, k, keep):
    terms = {e: stems(t) for e, t in docs.items()}
    terms = {e: t for e, t in terms.items() if t}
    n, avg = len(terms), max(sum(map(len, terms.values())) / max(1, len(terms)), 1.0)
    scores = {}
    for term in stems(text):
        df = sum(term in t for t in terms.values())
        for e, t in terms.items():
            tf = t.count(term)
            if tf:
                idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
                scores[e] = scores.get(e, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    return best({e: s for e, s in scores.items() if keep(e)}, k)


def pagerank(edges, seeds, rounds=25):
    s = {}
    for e, x in seeds:
        s[e] = max(s.get(e, 0.0), x, 0.0)
    total = sum(s.values())
    tele = {e: x / total if total else 1 / len(s) for e, x in s.items()}
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    rank = dict(tele)
    for _ in range(rounds):
        flow = {}
        for a, x in rank.items():
            for b in out.get(a, ()):
                flow[b] = flow.get(b, 0.0) + 0.85 * x / len(out[a])
        rest = 1 - sum(flow.values())
        new = {e: flow.get(e, 0.0) + rest * tele.get(e, 0.0) for e in {*flow, *tele}}
        moved = sum(abs(new.get(e, 0) - rank.get(e, 0)) for e in {*new, *rank})
        rank = new
        if moved < 1e-9:
            break
    return rank


def walk(entities, reasons, q, seeds, most, weights):
    content, w_reason, w_edge = weights
    links = {}
    for r in sorted(reasons, key=lambda r: r["reason_id"]):
        if r["to_net_id"] is None and r["kind"] != 3 and r["to_id"]:
            links.setdefault(r["from_id"], []).append((r, r["to_id"]))
            if r["to_id"] != r["from_id"]:
                links.setdefault(r["to_id"], []).append((r, r["from_id"]))

    def evidence(r):
        a, b = entities.get(r["from_id"]), entities.get(r["to_id"])
        mid = 0.0
        if a and b and usable(a["vector"], len(q)) and usable(b["vector"], len(q)):
            mid = cosine(np.float32([(x + y) / 2 for x, y in zip(a["vector"], b["vector"])]).tolist(), q)
        return round(w_reason * mid + w_edge * min(max(r["score"], 0.0), 1.0), 6)

    heap = [(-s, e, (e,)) for e, s in seeds]
    heapq.heapify(heap)
    seen, chains, credit, giver, paid, frontier, n = {}, [], {}, {}, set(), 0.0, 0
    while heap and n < most:
        n += 1
        s, e, path = heapq.heappop(heap)
        s = -s
        if e in seen:
            continue
        seen[e] = max(s, 0.0)
        if len(path) > 1:
            chains.append((path, s))
        bar = 0.25 * frontier
        for r, other in links.get(e, ()):
            if other not in entities or e not in entities:
                continue
            x = evidence(r)
            if x > 0 and (r["reason_id"], other) not in paid:
                paid.add((r["reason_id"], other))
                credit[other] = credit.get(other, 0.0) + 2.0 * s * x
                giver[other] = max(giver.get(other, 0.0), s)
            if other in seen:
                continue
            c = round(cosine(entities[other]["vector"] or [], q), 6)
            near = content * (0.0 if math.isnan(c) else c) + x
            if near >= bar:
                frontier = max(frontier, near)
                heapq.heappush(heap, (-near, other, (*path, r["reason_id"], other)))
    hits = []
    for e, s in seen.items():
        if e in entities:
            hits.append((e, max(s, min(s + min(credit[e], 0.5), np.nextafter(giver[e], -np.inf))) if e in credit else s))
    return hits, chains


def recall(entities, reasons, accesses, g, now, keep=None, expires=True, seed_k=25, most=800, deliver=40):
    """(rank, entity_id, score) and chains of one attractor's query; ``g`` is (vector, text, [(vector, mass)])."""
    q, text, attractors = g
    keep = keep or (lambda e: True)
    ok = lambda e: keep(entities[e])
    sim = {c: {e: cosine(r[c], q) for e, r in entities.items() if usable(r[c], len(q))} for c in ("vector", "gnn_vector")}
    width = max(2 * seed_k, 64)
    live = lambda c: {e: s for e, s in sim[c].items() if entities[e]["status"] != "superseded" and ok(e)}
    c, s = dict(best(live("vector"), width)), dict(best(live("gnn_vector"), width))
    blend = {e: 0.4 * c[e] + 0.6 * s[e] if e in c and e in s else c.get(e, s.get(e)) for e in {*c, *s}}
    blend = best(blend, seed_k)
    important = [(e, round(x, 6)) for e, x in sim["vector"].items() if round(x, 6) >= 0.2 and ok(e) and (
        not entities[e]["kern_id"].startswith("remote-") and entities[e]["kind"] == "fact" or accesses.get(e, 0) >= 3)]
    dense = best(pooled(blend, important), seed_k)
    lexical = bm25({e: r["text"] for e, r in entities.items()}, text, 4 * seed_k, ok)
    votes = [(r["from_id"], r["to_id"]) for r in reasons if not r["kern_id"].startswith("remote-") and r["from_id"] != r["to_id"] and r["from_id"] in entities and r["to_id"] in entities]
    ranks = best({e: x for e, x in pagerank(votes, dense + lexical).items() if x > 0}, 100, 9)
    fused = {}
    for rows, w in ((dense, 1.0), (lexical, 1.0), (important, 0.5), (ranks, 0.5)):
        for i, (e, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0]))):
            fused[e] = fused.get(e, 0.0) + w / (60 + i + 1)
    seeds = []
    for e, _ in best(fused, 2 * seed_k, 9):
        x = round(cosine(entities[e]["vector"] or [], q), 6) if entities[e]["vector"] is not None else 0.0
        seeds.append((e, 0.0 if math.isnan(x) else x))
    hits, chains = walk(entities, reasons, q, seeds, most, (0.5, 0.3, 0.2))
    rows = []
    for e, x in pooled(hits, seeds).items():
        r = entities.get(e)
        if r is None or not ok(e) or r["status"] == "superseded" or expires and r["valid_until"] is not None and r["valid_until"] < now:
            continue
        a, b = r["conf_alpha"], r["conf_beta"]
        mean, var = (a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))) if a + b > 0 else (0.5, 0.0)
        age = None if r["accessed_at"] is None else (now - r["accessed_at"]).total_seconds()
        x = x * max(0.0, mean - math.sqrt(var)) + min(0.1, math.log(accesses.get(e, 0) + 1) * 0.02 + (0.05 * math.exp(-max(age, 0) / 86400) if age is not None else 0.0))
        remote = r["kern_id"].startswith("remote-")
        x += 0.3 if r["kind"] == "fact" and not remote else 0.0
        if usable(r["vector"], len(q)):
            pulls = [m * cosine(r["vector"], v) for v, m in attractors if cosine(r["vector"], v) >= 0]
            x += 0.15 * max(pulls, default=0.0)
        rows.append((e, round(x * (0.4 if remote else 1.0), 6)))
    rows = sorted(rows, key=lambda x: (-x[1], x[0]))[: max(50, deliver)]
    if len(rows) > deliver:
        head, rest, chosen = rows[:50], rows[50:], []
        held = {e: entities[e]["vector"] for e, _ in head if entities[e]["vector"]}
        value = {e: cosine(held[e], q) if e in held else s for e, s in head}
        while len(chosen) < min(deliver, len(head)):
            def gain(e):
                near = [c for c in (cosine(held[e], held[d]) for d, _ in chosen if d in held) if not math.isnan(c)] if e in held else []
                x = round(0.75 * value[e] - 0.25 * max([0.0, *near]), 12)
                return -1e9 if math.isnan(x) else x
            left = [x for x in head if x not in chosen]
            top = max(gain(e) for e, _ in left)
            chosen.append(next(x for x in left if gain(x[0]) == top))
        rows = (chosen + rest)[:deliver]
    return [(i + 1, e, s) for i, (e, s) in enumerate(rows)], chains
