"""Plain single-process versions of the contracts, for comparison."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict

SPACE = "\x20\x09-\x0d"
WORD = re.compile(f"[^{SPACE}]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text: str) -> list:
    letters = "".join
    key = "|".join(letters(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = []
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return sorted(found)


def quality(text: str) -> tuple:
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    marked = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def line_key(line: str) -> str:
    return re.sub(f"^[{SPACE}]+|[{SPACE}]+$", "", line).translate(UPPER)


def kept_lines(docs: dict, least: int = 10) -> dict:
    count = Counter()
    for text in docs.values():
        count.update({line_key(x) for x in text.split("\n")} - {""})
    out = {}
    for i, text in docs.items():
        lines = text.split("\n")
        keep = [x for x in lines if line_key(x) == "" or count[line_key(x)] < least]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def shingle_set(text: str) -> frozenset:
    w = WORD.findall(text.translate(UPPER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near(docs: dict, percent: int = 75) -> dict:
    sets = {i: shingle_set(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared: Counter = Counter()
    for members in by.values():
        members.sort()
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in docs}


def article(page: str) -> str:
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    body = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", m.group(1))) if m else ""
    return " ".join(html.unescape(body).split())
