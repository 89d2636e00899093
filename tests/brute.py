"""Slow single-row versions of the linkage rules: every target against every page, no blocking.

"""

from vinculo.config import COMMON_SURNAMES, PARTICLES


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def jw(a, b):
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    if not a or not b or reach < 0:
        return 0.0
    taken, pairs = {}, []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == x), None)
        if j is not None:
            taken[j] = i
            pairs.append(x)
    m = len(pairs)
    if m == 0:
        return 0.0
    other = [b[j] for j in sorted(taken)]
    t = sum(x != y for x, y in zip(pairs, other)) / 2
    base = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return base + same * 0.1 * (1 - base)


def first_ok(a, b):
    if a == b:
        return True
    if a[0] != b[0] or min(len(a), len(b)) <= 3:
        return False
    return edits(a, b) <= 2 or jw(a, b) >= 0.85


def starts(x, y):
    return x.startswith(y) or y.startswith(x)


def score(t, c):
    if t == c:
        return 1.0
    a = [w for w in t.split(" ") if w not in PARTICLES and len(w) >= 2]
    b = [w for w in c.split(" ") if w not in PARTICLES and len(w) >= 2]
    if not a or not b or not first_ok(a[0], b[0]):
        return 0.0
    shared, rare = 0, False
    for x in a[1:]:
        for y in b[1:]:
            near = x == y or edits(x, y) <= 1
            big, small = max(len(x), len(y)), min(len(x), len(y))
            cut = len(x) >= 5 and len(y) >= 4 and starts(x, y) and small >= min(5, big * 0.6)
            if near or cut:
                shared += 1
                judged = x if near or len(x) > len(y) else y
                rare = rare or judged not in COMMON_SURNAMES
                break
    if shared == 0 and a[1:] and b[1:]:
        return 0.1
    last = False
    if a[1:] and b[1:]:
        x, y = a[-1], b[-1]
        last = edits(x, y) <= 1 or (min(len(x), len(y)) >= 4 and starts(x, y))
    clean = [" ".join(w for w in n.split(" ") if w not in PARTICLES) for n in (t, c)]
    s = jw(*clean)
    if rare:
        s = min(1.0, s + 0.05)
    if shared and not rare and len(a) > 2 and not last:
        s = min(s, 0.75)
    fj = jw(a[0], b[0])
    if fj >= 0.85 and last:
        s = max(s, 0.87)
    return s if a[0] == b[0] else s * fj


def page_hit(target, page, payees):
    """(rank, score) of the first method that hits, or None."""
    scores = [score(target, p) for p in payees]
    if any(s >= 0.85 for s in scores):
        return 1, 1.0
    for s in scores:
        if s >= 0.78:
            return 1, s
    if len(target) >= 8 and target in page:
        at = page.index(target)
        end = at + len(target)
        if (at == 0 or page[at - 1] == " ") and (end == len(page) or page[end] == " "):
            return 2, 0.8
    words = [w for w in target.split(" ") if len(w) >= 3]
    tokens = {w for w in page.split(" ") if len(w) >= 3}
    if len(words) >= 2:
        have = sum(w in tokens for w in words)
        if words[0] in tokens and words[-1] in tokens and have >= max(2, int(len(words) * 0.7)):
            pos = 0
            for w in words:
                pos = page.find(w, pos)
                if pos < 0:
                    break
                pos += len(w)
            if pos >= 0:
                return 3, 0.6
        i, j = page.find(words[0]), page.find(words[-1])
        if i >= 0 and j >= 0 and 0 < abs(i - j) < 100:
            return 4, 0.5
    return None


def link(targets, pages):
    """targets: [(emp_ord, norm)], pages: [(file_ord, page_no, norm, payees)], both in order."""
    found = []
    for emp, norm in targets:
        best = None
        for f, p, text, payees in pages:
            if best and f > best[0]:
                break
            hit = page_hit(norm, text, payees)
            if hit and (best is None or hit[1] > best[3]):
                best = (f, p, *hit[:1], hit[1])
        if best:
            found.append((emp, *best))
    top = {}
    for row in found:
        key = row[1:3]
        if key not in top or (-row[4], row[0]) < (-top[key][4], top[key][0]):
            top[key] = row
    return [(*row, top[row[1:3]] is row) for row in found]


def miss(norm, pages):
    words = [w for w in norm.split(" ") if len(w) >= 3]
    in_text = as_payee = False
    best, cand = 0.0, None
    for _, _, text, payees in pages:
        if norm in text:
            in_text = True
        if len(words) >= 2:
            i, j = text.find(words[0]), text.find(words[-1])
            if i >= 0 and j >= 0 and abs(i - j) < 100:
                in_text = True
        for p in payees:
            as_payee = as_payee or p == norm
            s = score(norm, p)
            if s > best:
                best, cand = s, p
    return in_text, as_payee, cand, best
