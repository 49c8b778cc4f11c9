"""Plain versions of the corpus operators, one text at a time, to hold results against."""

import hashlib
import html
import math
import re
from collections import Counter, defaultdict

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def line_dedup(docs):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(LOWER)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10 and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def secrets(docs):
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = []
    for i, text in docs:
        found = []
        for m in assign.finditer(text or ""):
            if len(m[2]) >= 6:
                found.append((m.start(), 0, m.end(), "assign"))
        for n, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
            found += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[0]) >= least]
        spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
        out.append((i, *(sum(x[3] == k for x in found) for k in ("assign", "access", "hex")), sha(spans), spans))
    return out


def rules(docs):
    out = []
    for i, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        at = defaultdict(list)
        for k in range(len(words) - 7):
            at[tuple(words[k : k + 8])].append(k)
        again = {k + d for ks in at.values() if len(ks) > 1 for k in ks for d in range(8)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        n = len(words)
        out.append((i, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again), n < 20 or 100 * len(again) > 30 * n))
    return out


def components(nodes, links):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in nodes}


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def ngram_join(docs, n=3, hundredths=90):
    sets = [(i, shingles(t, n)) for i, t in docs]
    holders = defaultdict(list)
    links = set()
    for k, (i, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(k)
        for j, c in shared.items():
            if 100 * c >= hundredths * (len(s) + len(sets[j][1]) - c):
                links.add((sets[j][0], i))
    of = components({i for i, _ in docs}, links)
    return [(i, len(s), of[i]) for i, s in sets]


def rank_merges(ranks, word):
    """Ids of a run of one byte: every pass over the parts merges all pairs of the least rank, from the left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [ranks[x] for x in {a + b for a, b in zip(parts, parts[1:])} if x in ranks]  # noqa: B905
        if not found:
            return [ranks[p] for p in parts]
        least, out, i = min(found), [], 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get(parts[i] + parts[i + 1]) == least:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


DROP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
LANG = re.compile(rb"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})")
URL = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://([^/?#:]*)(?::\d+)?(?:/([a-z]{2})(?=[/?#]|$))?")


def page_text(page):
    return html.unescape(DROP.sub(b" ", (page or "").encode()).decode())


def language(pages, docs):
    """(page, language, confidence): likelihoods, declared language, address and host prior, added up in plain loops."""

    def buckets(text):
        x = b" " + b" ".join(text.encode().lower().split()) + b" "
        return [(((x[k] * 65599 + x[k + 1]) * 65599 + x[k + 2]) * 2654435761 % 2**32) >> 17 for k in range(len(x) - 2)]

    counts = defaultdict(Counter)
    for lang, text in docs:
        if lang is not None and text is not None:
            counts[lang].update(buckets(text))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * 2**15 for x in langs}
    rows = []
    for i, url, page in pages:
        text, m = page_text(page), URL.match(url or "")
        host = (m[1] if m else "").lower()
        said = LANG.search((page or "").encode())
        ll = [0.25 * sum(math.log((counts[x][b] + 0.5) / total[x]) for b in buckets(text)) if text.strip() else 0.0 for x in langs]
        top = langs[ll.index(max(ll))] if text.strip() else None
        rows.append((i, host, ".".join(host.split(".")[-3:]), host.rpartition(".")[2] + "/" + ((m[2] or "") if m else "").lower(), said[1].decode().lower() if said else "", ll, top))
    votes = [defaultdict(Counter) for _ in range(5)]  # by nothing, host, domain, address, declared language
    for _, host, domain, address, said, _, top in rows:
        for v, k in zip(votes, ("", host, domain, address, said), strict=True):
            v[k][top] += 1
    every = votes[0][""]
    n = sum(every[x] for x in langs)
    out = []
    for i, host, domain, address, said, ll, top in rows:
        s = []
        share = [votes[2][domain][x] + 8 * (every[x] + 1) / (n + len(langs)) for x in langs]
        for k, x in enumerate(langs):
            value = ll[k] - max(ll) + math.log(votes[1][host][x] - (top == x) + 4 * share[k] / sum(share))
            for v, key in ((votes[3], address), (votes[4], said)):
                value += math.log((v[key][x] + 0.05) / (every[x] + 1)) if key else 0.0
            s.append(value)
        best = max(s)
        out.append((i, langs[s.index(best)], 1 / sum(math.exp(x - best) for x in s)))
    return out


def decision_list(rows, names, precision, least):
    """Rules from (label, kept apart, values): sequential covering over thresholds at the values' 24-quantiles."""
    ranked = {f: sorted(r[2][f] for r in rows) for f in names}
    edges = {f: sorted({ranked[f][math.ceil(k / 24 * len(rows)) - 1] for k in range(1, 24)}) for f in names}
    holds = lambda rule, r: all((r[2][f] <= e) if sign == "<=" else (r[2][f] > e) for f, sign, e in rule)
    rules, left = [], rows
    while True:
        rule, inside = [], [r for r in left if not r[1]]
        while True:
            bad0 = sum(r[0] == 0 for r in inside)
            good0 = len(inside) - bad0
            if bad0 < least or good0 == 0:
                break
            best = (0.0,)
            for k, f in enumerate(names):
                for b, e in enumerate(edges[f]):
                    for sign in ("<=", ">"):
                        part = [r[0] for r in inside if holds([(f, sign, e)], r)]
                        bad = part.count(0)
                        if bad:
                            gain = bad * (math.log2(bad / len(part)) - math.log2(bad0 / (bad0 + good0)))
                            best = max(best, (gain, -k, -b, f, sign, e))
            if best[0] <= 1e-9:
                break
            rule.append(best[3:])
            inside = [r for r in inside if holds(rule, r)]
        if rule:
            apart = [[r[0] for r in left if r[1] and holds(rule[:n], r)] for n in range(1, len(rule) + 1)]
            worth = [(2 * x.count(0) - len(x)) / len(x) if x else -1.0 for x in apart]
            n = worth.index(max(worth)) + 1
            rule = rule[:n] if apart[n - 1] and apart[n - 1].count(0) / len(apart[n - 1]) >= precision else []
        if not rule:
            return rules
        rules.append(rule)
        left = [r for r in left if not holds(rule, r)]
