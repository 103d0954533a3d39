"""Plain-Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from skein.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {i + k for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def line_key(line: str) -> str:
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower())).strip(" ")


def frequent(docs: list[dict], min_docs: int = 10, max_share: float = 0.1, max_docs: int = 100) -> set[tuple[str, str]]:
    holders, texts = defaultdict(set), defaultdict(set)
    for d in docs:
        host, text = d["source"] or "", d["text"] or ""
        texts[host].add(text)
        for line in text.split("\n"):
            if WORD.search(line):
                holders[host, line_key(line)].add(text)
    return {k for k, v in holders.items() if len(v) > min_docs and (len(v) > max_share * len(texts[k[0]]) or len(v) > max_docs)}


def quality(docs: list[dict]) -> list[dict]:
    """Kept documents without their frequent lines."""
    marked = frequent(docs)
    out = []
    for d in docs:
        n, *_, failed = base(d["text"])
        lines = (d["text"] or "").split("\n")
        gone = [x for x in lines if WORD.search(x) and (d["source"] or "", line_key(x)) in marked]
        left = n - sum(len(words(x)) for x in gone)
        if not failed and left >= 10 and left >= 0.3 * n:
            out.append(d | {"text": "\n".join(x for x in lines if x not in gone)})
    return out


def shingles(text: str | None) -> frozenset[tuple[str, ...]]:
    ws = words((text or "").lower())
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def classes(texts: dict[int, str | None], percent: int = 80) -> tuple[dict[int, int], Counter]:
    """(class id, number of links) of each document, from all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    order = {i: tuple(words((t or "").lower())) for i, t in texts.items()}
    root = {i: i for i in texts}
    links: Counter = Counter()

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    holders = defaultdict(list)
    for i in ids:
        shared = Counter(k for g in sets[i] for k in holders[g])
        alike = {k for k, n in shared.items() if 100 * n >= percent * (len(sets[i]) + len(sets[k]) - n)}
        alike |= {k for k in ids if k < i and not sets[k] and order[k] == order[i]} if not sets[i] else set()
        for k in alike:
            links[i] += 1
            links[k] += 1
            a, b = sorted((find(i), find(k)))
            root[b] = a
        for g in sets[i]:
            holders[g].append(i)
    return {i: find(i) for i in ids}, links


def water_fill(budget: int, children: dict[str, tuple[int, int]]) -> dict[str, int]:
    """Divide a budget by weight among (capacity, weight), none above its capacity."""
    out, rest = {}, dict(children)
    while rest:
        total = sum(w for _, w in rest.values())
        full = [k for k, (cap, w) in rest.items() if cap * total <= budget * w]
        if not full:
            return out | {k: budget * w // total for k, (_, w) in rest.items()}
        first = min(full, key=lambda k: (rest[k][0] / rest[k][1], k))
        out[first] = rest.pop(first)[0]
        budget -= out[first]
    return out


def mix(docs: list[dict]) -> Counter:
    """Copies of each doc_id."""
    leaves: dict[tuple[str, str, str], list[tuple[int, str, int]]] = defaultdict(list)
    for d in docs:
        source = d["source"] or ""
        number = re.search("([0-9]{1,9})$", source)
        domain = mixing.DOMAINS[int(number[1]) % 4 if number else 0]
        if n := len(words(d["text"])):
            leaves[domain, d["lang"] or "", source].append((d["doc_id"], hashlib.md5((d["text"] or "").encode()).hexdigest(), n))
    available = {k: sum(n for _, _, n in v) for k, v in leaves.items()}
    total = sum(available.values())
    budgets: dict[tuple[str, ...], int] = {(): min(total * mixing.BUDGET_PERCENT // 100, total * mixing.MAX_EPOCHS)}
    for depth, level in enumerate(mixing.LEVELS):
        below: dict[tuple[str, ...], int] = {}
        for parent, budget in budgets.items():
            children: dict[str, tuple[int, int]] = {}
            for leaf, n in available.items():
                if leaf[:depth] == parent:
                    cap, _ = children.get(leaf[depth], (0, 0))
                    children[leaf[depth]] = (cap + n * mixing.MAX_EPOCHS, mixing.WEIGHTS[level].get(leaf[depth], 1))
            below |= {(*parent, k): v for k, v in water_fill(budget, children).items()}
        budgets = below
    copies: Counter = Counter()
    for leaf, rows in leaves.items():
        epochs, prefix = divmod(budgets[leaf], available[leaf])
        used = 0
        for doc_id, text, n in sorted(rows, key=lambda r: hashlib.md5(f"{mixing.SEED}|{epochs}|{r[0]}|{r[1]}".encode()).hexdigest()):
            used += n
            copies[doc_id] = epochs + (used <= prefix)
    return copies
