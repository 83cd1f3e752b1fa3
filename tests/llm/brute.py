"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
from html.parser import HTMLParser

SPACE = re.compile(r"[\x20\x09-\x0D]")


def quality_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    under = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    out = dict(n_words=len(words), word_chars=sum(map(len, words)), n_symbols=len(re.findall(r"[#*$%&|<>]", text)),
               n_dup_lines=dup, n_repeat_words=len(under))
    out["base_failed"] = len(words) < 20 or 100 * len(under) > 30 * len(words)
    return out


def exact_groups(rows):
    """[(doc_id, text)] -> sorted (doc_id, keep_id, group_size, kept, text_sha256), with distinct doc_ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((i, t or ""))
    out = []
    for flat, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        sha = hashlib.sha256(flat.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep, sha) for i, _ in members]
    return sorted(out)


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and _luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def pii_base(text):
    """[(kind, start, end)] by start, then kind as listed."""
    found = []
    for k, (name, (pattern, good)) in enumerate(KINDS.items()):
        found += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text or "") if good(m.group())]
    return [(n, s, e) for s, _, n, e in sorted(found)]


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


class PlainPage(HTMLParser):
    """Visible characters of a well-formed page, without white space: every element but the unseen ones, a mark for each list item."""

    def __init__(self):
        super().__init__()
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("meta", "br"):
            self.open.append(tag)
        if tag == "li":
            self.out.append("-")

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag):]

    def handle_data(self, data):
        if not {"head", "script", "style"} & set(self.open):
            self.out.append(data)


def plain_page(page):
    parser = PlainPage()
    parser.feed(page or "")
    parser.close()
    return "".join("".join(parser.out).split())
