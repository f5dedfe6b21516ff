"""Queries that SQL cannot express, against plain loops over small tables with gaps, nulls, ties and repeated rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from seqloom.functions import search
from seqloom.operators import greedy, hmm
from seqloom.queries import all_queries

TURN = str.maketrans("ACGT", "TGCA")
READ = str.maketrans("MYHRSKVDBW", "CCCGGGGGGT")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folder with small tables, and their rows."""
    r = random.Random(11)
    d = tmp_path_factory.mktemp("tables")
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    lib = {f"fam{i}": 200 + 40 * i for i in range(8)}
    kinds = ["DNA/hAT", "LTR/Gypsy", "LINE/L1", "LTR/Copia"]
    library = [(n, kinds[i % 4], None if i == 7 else k, i + 1) for i, (n, k) in enumerate(lib.items())]
    rm = []
    for i in range(260):
        name = r.choice(list(lib))
        a = r.randint(1, lib[name] - 30)
        b = min(lib[name], a + r.choice([20, 60, 150, lib[name]]))
        if r.random() < 0.3:
            a, b = 1, lib[name] - r.randint(0, 4)
        at = r.choice([r.randint(1, 2500), 300, 320])
        left = f"({lib[name] - b})"
        plus = r.random() < 0.6
        c1, c3 = (str(a), left) if plus else (left, str(a))
        rm.append((i, i // 2 if i < 20 else i, r.choice(["g1", "g1", None if i % 40 == 0 else "g2"]), 500, r.choice([2.0, 8.0, 30.0, None]), r.choice(["s1", "s2"]), at, at + b - a, "(100)", "+" if plus else "C", r.choice([name, f" {name}"]) if i % 50 else None, r.choice(["LTR/Gypsy", "DNA/hAT", None]), c1, str(b), c3, i))
    rm += rm[30:35]
    copies = [(i, i - (i % 9 == 0), "g1", r.choice(["c1", "c2"]), (s := r.choice([r.randint(0, 900), 100, 101])), s + r.choice([0, 5, 100, 102, 104]), r.choice("+-C"), r.choice(["fam1", "fam2 ", "fam3", "fam4", None, ""]), "f", "LTR", r.choice([None, 3, 4])) for i in range(160)]
    ltr = [(i % 70, r.choice(["x", "x", "y "]), (s := r.choice([r.randint(1, 700), 50, 52])), s + r.choice([0, 20, 100, 101, 103, 300]), "TSD:NA", 95.0) for i in range(75)]
    seqs, bases = [], [dna(n) for n in (60, 150, 400)]
    for i in range(36):
        b = r.choice(bases)
        s = "".join(c if r.random() > 0.02 else r.choice("ACGTN") for c in b) if i % 3 else dna(r.choice([0, 5, 39, 41, 90]))
        tail = r.choice(["", "A" * 9, "AAATAAA", "ACACACAC", "AGTAGTAGTAGT", "T" * 6 + "G"])
        seqs.append((i, f"n{i}", r.choice(["g1", "g2", None]), r.choice([s, s.lower(), s[:10] + "\n" + s[10:]]) + tail))
    seqs += [(90, "n90", "g1", None), (91, "n91", "g1", ""), (92, "n92", "g1", "CAGCA" + dna(400) + "GGCCTTTTAAGGCCAACTAGT" + dna(40)), (93, "n93", "g1", "ACGTAC" * 30)]
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write("te_library", library, "te_name string, te_class string, cons_len int, ordinal long")
    write("rm_out", rm, "ordinal long, ann_id long, genome string, sw_score int, pct_div double, seq_name string, seq_begin long, seq_end long, left_bp string, strand string, ele string, ele_class string, c1 string, c2 string, c3 string, hit_id long")
    write("te_copies", copies, "ordinal long, copy_id long, genome string, chrom string, te_start long, te_end long, strand string, te_name string, te_fam string, te_class string, score int")
    write("ltr_intact", ltr, "ltr_id long, chr string, element_start long, element_end long, tsd string, ltr_identity double")
    write("sequences", seqs, "seq_id long, chrname string, genome string, chrseq string")
    clean = {i: re.sub(r"\s", "", s).upper().translate(READ) for i, _, _, s in seqs if s is not None}
    genome = {i: g for i, _, g, s in seqs if s is not None}
    elements = sorted({(i, c.strip(), min(a, b), max(a, b)) for i, c, a, b, *_ in ltr}, key=lambda x: (x[1], x[2], x[3], x[0]))
    return {"dir": str(d), "library": library, "rm": rm, "copies": copies, "elements": elements, "seqs": clean, "genome": genome}


@pytest.fixture(scope="module")
def run(spark, tables):
    return lambda name: [tuple(r) for r in all_queries()[name](spark, tables["dir"]).collect()]


# ---- functions on sequences


def tail_is_near(s, n=6, wrong=1, reach=5):
    return any(min(sum(c != b for c in s[i : i + n]) for b in "AT") <= wrong for i in range(max(0, len(s) - n - reach), len(s) - n + 1))


def repeats_near_tail(s, reach=5):
    return any(s[a : a + u] * 3 == s[a : a + 3 * u] and a + 3 * u >= len(s) - reach for a in range(len(s)) for u in range(2, len(s) // 3 + 1))


def test_tails(run, tables):
    s = tables["seqs"]
    assert dict(run("fn_f26_repeat_tail")) == {i: repeats_near_tail(q[-20:]) for i, q in s.items()}
    assert dict(run("fn_f27_sine_tail")) == {i: tail_is_near(q) or repeats_near_tail(q[-20:]) for i, q in s.items()}
    assert len(set(dict(run("fn_f27_sine_tail")).values())) == 2


def test_nearest_poly_a(run, tables):
    def longest(x):
        best = run_ = 0
        for c in x:
            run_ = run_ + 1 if c == "A" else 0
            best = max(best, run_)
        return best if best >= 6 else 0

    want = {i: "A" * max(longest(q[:30]), longest(q[-30:])) or None for i, q in tables["seqs"].items()}
    assert dict(run("fn_f23_nearest_poly_a")) == want and any(want.values())


def test_longest_tail_repeat(run, tables):
    def brute(q):
        t, best = q[-20:], None
        for u in range(2, 7):
            for a in range(len(t)):
                n = 1
                while n * u + a + u <= len(t) and t[a + n * u : a + n * u + u] == t[a : a + u]:
                    n += 1
                key = (n * u, -u, a)
                if n >= 2 and (best is None or key > best[0]):
                    best = (key, t[a : a + u], len(q) - len(t) + a + n * u)
        return best[1:] if best else (None, -1)

    assert {i: x for i, *x in run("fn_f28_longest_tail_repeat")} == {i: list(brute(q)) for i, q in tables["seqs"].items()}


def test_confident_site(run, tables):
    def brute(q):
        start, end = 31, len(q) - 30
        left, right, best = q[10:30], q[end : end + 20], None
        for k in range(2, 16):
            for i in range(len(left) - k + 1):
                w = left[i : i + k]
                if "N" in w:
                    continue
                for j in range(len(right) - k + 1):
                    diff = [b for a, b in zip(w, right[j : j + k]) if a != b]
                    if not diff or (k >= 8 and len(diff) == 1 and diff[0] in "ACGT"):
                        key = (len(left) - i - k + j, -k, len(left) - i - k)
                        if best is None or key < best[0]:
                            best = (key, w)
                        break
        return [best[1], best[0][0]] if best else [None, -1]

    want = {i: brute(q) for i, q in tables["seqs"].items() if len(q) >= 100}
    assert {i: x for i, *x in run("fn_f19_confident_site")} == want and any(v[0] for v in want.values())


def test_aligned_site(run, tables):
    def brute(q):
        row = q.replace("N", "-")
        for n in range(2, 12):
            a, b = row[:30].replace("-", "")[-n:], row[len(row) - 30 :].replace("-", "")[:n]
            if len(a) == len(b) == n and sum(x != y for x, y in zip(a, b)) <= (1 if n >= 8 else 0):
                return a
        return None

    assert dict(run("fn_f20_aligned_site")) == {i: brute(q) for i, q in tables["seqs"].items() if len(q) >= 100}


def test_clean_up(run, tables):
    def tandem(q):
        i = inside = 0
        while i < len(q):
            for u in range(1, 7):
                w, n = q[i : i + u], 1
                while len(w) == u and set(w) <= set("ACGT") and q[i + n * u : i + n * u + u] == w:
                    n += 1
                if n >= 5:
                    inside += n * u
                    i += n * u
                    break
            else:
                i += 1
        return inside / len(q)

    want = {i for i, q in tables["seqs"].items() if len(q) >= 80 and q.count("N") < 0.2 * len(q) and tandem(q) <= 0.5}
    got = {x[0] for x in run("flt_p8_clean_up")}
    assert got == want and 93 not in got


def test_helitron_ends(run, tables):
    def brute(q):
        out = []
        for at in range(len(q) - 4):
            wrong = sum(a != b for a, b in zip(q[at : at + 5], "CTAGT"))
            if wrong > 1:
                continue
            best = None
            for end in range(at, max(-1, at - 13), -1):
                for k in range(5, 9):
                    for gap in range(1, 10):
                        a = end - 2 * k - gap
                        if a >= 0 and q[a : a + k] == q[end - k : end].translate(TURN)[::-1]:
                            best = max(best or (0, 0), (k, a))
            if best:
                heads = [h for h in range(max(0, best[1] - 3000), best[1] + 1) if q[h : h + 2] == "TC" and len(q) - h >= 9 and sum(a != b for a, b in zip(q[h : h + 9], "TCTCTACTA")) <= 2]
                out.append((best[1], at + 5, int(wrong > 0), heads[-1] if heads else -1))
        return out

    want = sorted((i, *x) for i, q in tables["seqs"].items() for x in brute(q))
    assert sorted(run("v19_hairpin_ends")) == want and any(x[3] == 0 for x in want if x[0] == 92)


def test_scores_and_runs(run, tables):
    def table(a, b, local):
        t, best = {}, 0
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                o = [0] if i == j == 0 or local else []
                o += [t[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1)] if i and j else []
                o += [t[i - 1, j] - 1] if i else []
                o += [t[i, j - 1] - 1] if j else []
                t[i, j] = max(o)
                best = max(best, t[i, j])
        return best if local else t[len(a), len(b)]

    got = {i: x for i, *x in run("v17_alignment_scores")}
    assert set(got) == {i for i, q in tables["seqs"].items() if q}
    for i in [i for i in got if len(tables["seqs"][i]) < 80]:
        q = tables["seqs"][i]
        a, b = q[: len(q) // 2], q[len(q) // 2 :]
        assert got[i][:2] == [table(a, b, False), table(a, b, True)]
    want = set()
    for i, q in tables["seqs"].items():
        last, dist = {}, {}
        for p in range(len(q) - 8, -1, -1):
            w = q[p : p + 8]
            if w in last and 20 <= last[w] - p <= 2000:
                dist[p] = last[w] - p
            last[w] = p
        runs = defaultdict(list)
        for p, x in sorted(dist.items()):
            rs = runs[x]
            if rs and rs[-1][1] == p - 1:
                rs[-1][1] = p
            else:
                rs.append([p, p])
        bands = defaultdict(list)
        for x, rs in runs.items():
            bands[x // 10] += [(a + 1, b + 8) for a, b in rs if b - a + 1 >= 5]
        for band, rs in bands.items():
            cur = None
            for a, b in sorted(rs):
                if cur and a <= cur[1] + 101:
                    cur[1] = max(cur[1], b)
                else:
                    if cur and cur[1] - cur[0] >= 11:
                        want.add((i, band * 10, *cur))
                    cur = [a, b]
            if cur and cur[1] - cur[0] >= 11:
                want.add((i, band * 10, *cur))
    assert set(run("v5_gapped_repeats")) == want


# ---- intervals in order


def overlap(a, b, share):
    n = min(a[3], b[3]) - max(a[2], b[2])
    la, lb = a[3] - a[2], b[3] - b[2]
    return a[1] == b[1] and la > 0 and lb > 0 and n >= share * la and n >= share * lb


def test_positional_rules(run, tables):
    kept, heads, out = [], {}, {}
    for e in tables["elements"]:
        if not any(overlap(e, k, 0.95) for k in kept):
            kept.append(e)
        h = heads.get(e[1])
        # a run ends with its island: elements further on cannot overlap its head
        if h is None or not overlap(e, h, 0.95):
            h = heads[e[1]] = e
        out.setdefault((e[0], h[0]), 0)
        out[e[0], h[0]] += 1
    assert sorted(x[0] for x in run("iv_i10_positional_dedup")) == sorted(k[0] for k in kept)
    assert Counter(run("iv_i11_run_heads")) == Counter(out)


def test_successor_removal(run, tables):
    want = []
    for c in {e[1] for e in tables["elements"]}:
        stack = []
        for e in [e for e in tables["elements"] if e[1] == c]:
            while stack and e[2] <= stack[-1][2] <= e[3] and e[2] <= stack[-1][3] <= e[3]:
                stack.pop()
            stack.append(e)
        want += [e[0] for e in stack]
    assert sorted(x[0] for x in run("v9_successor_removal")) == sorted(want)


def test_deep_piles_against_loops(spark):
    """Many intervals in one island, nested and shifted: the same as comparing with every kept one."""
    r = random.Random(3)
    rows = list({(i, "k", (s := r.randint(0, 400)), s + r.choice([0, 1, 7, 50, 100, 101, 103, 300])) for i in range(250)})
    df = spark.createDataFrame(rows, "id long, k string, s long, e long")
    for share in (0.6, 0.9):
        kept = []
        for x in sorted(rows, key=lambda x: (x[2], x[3], x[0])):
            if not any(overlap(x, y, share) for y in kept):
                kept.append(x)
        assert sorted(x.id for x in greedy.keep_first_overlapping(df, ["k"], "id", "s", "e", share).collect()) == sorted(x[0] for x in kept)
    kept = []
    for x in sorted(rows, key=lambda x: (x[2] - x[3], x[2], x[3], x[0])):
        if not any(min(x[3], y[3]) - max(x[2], y[2]) + 1 > 0.5 * (x[3] - x[2] + 1) for y in kept):
            kept.append(x)
    assert sorted(x.id for x in greedy.drop_overlapping(df, ["k"], "s", "e", 0.5).collect()) == sorted(x[0] for x in kept)


# ---- chains


def hits_of(tables):
    out = set()
    for _, ann, g, _, _, seq, b, e, _, strand, ele, _, c1, c2, c3, _ in tables["rm"]:
        if g is None or ele is None:
            continue
        plus = strand == "+"
        num = lambda x: int(x.strip("()"))
        qs, left = (num(c1), num(c3)) if plus else (num(c3), num(c1))
        out.add((ann, ele.strip(), f"{g}:{seq}", qs, int(c2), int(c2) + left, b if plus else e, e if plus else b))
    return out


def chain_loop(hits, gap, q_gap=None, many=True):
    """Chains by query, subject and strand; every hit is compared with every chain that is not too far."""
    groups = defaultdict(list)
    for q, s, qs, qe, ss, se, n in hits:
        groups[q, s, ss <= se].append((qs, qe, ss, se, n))
    out = []
    for (q, s, plus), hs in groups.items():
        g = gap(hs[0][4])
        qg = g if q_gap is None else q_gap(g)
        made = []
        for qs, qe, ss, se, _ in sorted(hs, key=lambda h: (h[2], h[3], h[0], h[1]) if plus else (-h[2], -h[3], h[0], h[1])):
            grown = False
            for c in reversed(made):
                if (ss - c["se"] if plus else c["se"] - ss) >= g:
                    break
                if qs - c["qe"] < qg and qe > c["qe"] and (se > c["se"] if plus else se < c["se"]):
                    if plus:
                        c["qs"] = min(c["qs"], qs)
                    c["ss"] = min(c["ss"], ss) if plus else max(c["ss"], ss)
                    c["qe"], c["se"] = qe, se
                    c["n"] += 1
                    grown = True
                    if not many:
                        break
            if not grown:
                made.append({"qs": qs, "qe": qe, "ss": ss, "se": se, "n": 1})
        out += [(q, s, plus, c["qs"], c["qe"], c["ss"], c["se"], c["n"]) for c in made]
    return out


def test_chains(run, tables):
    h = [(q, s, qs, qe, ss, se, n) for _, q, s, qs, qe, n, ss, se in hits_of(tables)]
    total = {x[0]: x[6] for x in h}
    half = lambda n: n // 2
    g1 = chain_loop(h, half)
    assert Counter(run("chain_g1_extend")) == Counter(g1) and any(c[7] > 1 for c in g1)
    assert Counter(x[:8] for x in run("chain_g4_from_blast")) == Counter(g1)
    assert Counter(run("chain_g6_fixed_gap")) == Counter(chain_loop(h, lambda n: 200, many=False))
    for name, t in (("chain_g3_full_length", 0.95), ("chain_g3_share_of_length", 0.3)):
        c = chain_loop(h, lambda n, t=t: int(n * (1 - t)))
        size = lambda c: (c[4] - c[3] + 1, abs(c[6] - c[5]) + 1)
        want = [x for x in c if size(x)[0] >= t * total[x[0]] and min(size(x)) >= t * max(size(x))]
        assert Counter(run(name)) == Counter(want) and want
    c5 = chain_loop(h, lambda n: 300, lambda g: g / 3)
    want = []
    for s in {c[1] for c in c5}:
        kept = []
        for c in sorted((c for c in c5 if c[1] == s), key=lambda c: (-abs(c[6] - c[5]), min(c[5], c[6]), max(c[5], c[6]), c[0], c[2], c[3], c[4], c[5], c[6], c[7])):
            a, b = sorted(c[5:7])
            if not any(min(b, max(k[5:7])) - max(a, min(k[5:7])) + 1 > 0.5 * (b - a + 1) for k in kept):
                kept.append(c)
        want += kept
    got = run("chain_g5_protein")
    assert len(got) == len(want) and Counter(x[:3] for x in got) == Counter(x[:3] for x in want)
    best = {}
    for q, s, _, _, _, ss, se, _ in g1:
        a, b = sorted((ss, se))
        best[q] = max(best.get(q, (0, "", 0, 0)), (b - a, s, a, b))
    assert set(run("chain_g7_coarse_boundaries")) == {(q, s, max(1, a - 50), b + 50) for q, (_, s, a, b) in best.items()}
    # close hits, then the longest chain of each cluster
    spans = defaultdict(list)
    for q, s, qs, qe, ss, se, n in h:
        spans[q, s, ss <= se].append((min(ss, se), max(ss, se) + max(n // 2 - 1, 0)))
    best = {}
    for c in g1:
        cur, clusters = None, []
        for a, b in sorted(spans[c[:3]]):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
            else:
                cur = [a, b]
                clusters.append(cur)
        lo, hi = sorted(c[5:7])
        at = next(x[0] for x in clusters if x[0] <= lo <= x[1])
        key = (c[4] - c[3], hi - lo, -lo, -c[3])
        if (*c[:3], at) not in best or key > best[(*c[:3], at)][0]:
            best[(*c[:3], at)] = (key, c)
    want = Counter((c[0], c[1], c[2], *c[3:8]) for _, c in best.values() if c[4] - c[3] + 1 >= 0.3 * total[c[0]])
    assert Counter(x[:8] for x in run("chain_g2_longest")) == want


# ---- clusters


def first_come(order, links):
    taken = {}
    for q in order:
        if taken.get(q, q) == q:
            taken[q] = q
            for s in order:
                if s in links.get(q, ()) and s not in taken:
                    taken[s] = q
    return taken


def groups_of(nodes, near):
    """Smallest reachable node of each node."""
    label = {}
    for n in sorted(nodes):
        if n not in label:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = n
                    todo += [y for y in nodes if y not in label and near(x, y)]
    return label


def differ(a, b):
    return sum(x != y for x, y in zip(a, b)) + 99 * (len(a) != len(b))


def test_end_frames(run, tables):
    frame = {i: q[:20] + q[-20:] for i, q in tables["seqs"].items() if len(q) >= 40}
    assert dict(run("clu_c4_components")) == groups_of(frame, lambda a, b: differ(frame[a], frame[b]) <= 4)
    kept = []
    for i in sorted(frame):
        if not any(differ(frame[i], frame[k]) <= 4 for k in kept):
            kept.append(i)
    assert sorted(x[0] for x in run("clu_c7_by_flanks")) == kept and len(kept) < len(frame)
    want = {}
    for g in {"g1", "g2"}:
        shares = []
        for end in (slice(0, 20), slice(-20, None)):
            w = {i: tables["seqs"][i][end] for i in frame if tables["genome"][i] == g}
            n = Counter(groups_of(w, lambda a, b: differ(w[a], w[b]) <= 2).values())
            shares.append(round(sum(k for k in n.values() if k > 1) / len(w), 6))
        want[g] = (*shares, shares[0] < 0.9 and shares[1] < 0.9)
    assert {g: tuple(x) for g, *x in run("clu_c8_flank_share")} == want


def copies_of(tables):
    return {(i, f"{g}:{c[-1]}", s + 1, e, n.strip()) for _, i, g, c, s, e, _, n, *_ in tables["copies"] if s < e and n and n.strip()}


def test_names_at_one_place(run, tables):
    c = copies_of(tables)
    same = lambda a, b, share: a[4] != b[4] and overlap(a[:4], b[:4], share)
    kept = []
    near = {i: {y[0] for x in c if x[0] == i for y in c if same(x, y, 0.98) and y[0] != i} for i in {x[0] for x in c}}
    for i in sorted(near):
        if not near[i] & set(kept):
            kept.append(i)
    assert sorted(x[0] for x in run("join_j5_kept_copies")) == kept and len(kept) < len(near)
    order = sorted({x[4] for x in c}, key=lambda n: (min(x[0] for x in c if x[4] == n), n))
    names = []
    for n in order:
        if not any(same(x, y, 0.9) for x in c for y in c if x[4] == n and y[4] in names and x[0] != y[0]):
            names.append(n)
    assert sorted(x[0] for x in run("clu_c6_unique_names")) == sorted(names)


def library_chains(tables):
    h, hits = list(hits_of(tables)), set()
    for _, q1, s1, a1, b1, n1, x1, y1 in h:
        for _, q2, s2, a2, b2, n2, x2, y2 in h:
            lo, hi = max(min(x1, y1), min(x2, y2)), min(max(x1, y1), max(x2, y2))
            if s1 != s2 or q1 == q2 or lo > hi:
                continue
            at = lambda a, b, x, y, p: min(a + (p - x if x <= y else x - p), b)
            u, v, s, t = at(a1, b1, x1, y1, lo), at(a1, b1, x1, y1, hi), at(a2, b2, x2, y2, lo), at(a2, b2, x2, y2, hi)
            hits.add((q1, q2, *((v, u, t, s) if u > v else (u, v, s, t)), n1))
    best = {}
    for q, s, _, a, b, x, y, _ in chain_loop(hits, lambda n: n // 5):
        best[q, s] = max(best.get((q, s), (0, 0)), (b - a + 1, abs(y - x) + 1))
    return best


def test_library_clusters(run, tables):
    best = library_chains(tables)
    size = {n: k for n, _, k, _ in tables["library"] if k is not None}
    kind = {n: c.split("/")[0] for n, c, *_ in tables["library"]}
    links = defaultdict(set)
    for (q, s), (a, b) in best.items():
        if q in size and s in size and (a >= 0.8 * size[q] or b >= 0.8 * size[s]):
            links[q].add(s)
    order = [n for n, _, k, _ in tables["library"] if k is not None]
    want = {n: n for n in order} | first_come(order, links)
    assert dict(run("clu_c2_first_come")) == want and len(set(want.values())) < len(want)
    inside = {(q, s) for (q, s), (a, b) in best.items() if q in size and s in size and kind[q] == "DNA" and kind[s] == "LTR" and (a >= 0.95 * size[q] or b >= 0.95 * size[s])}
    assert set(run("clu_c9_contained_names")) == inside


def test_identity_clusters(run, tables):
    def seeds(texts):
        words = {i: {q[p : p + 16] for p in range(len(q) - 15) if "N" not in q[p : p + 16]} for i, q in texts.items()}
        n = {(a, b): len(words[a] & words[b]) for a in words for b in words if a != b}
        return {k: v for k, v in n.items() if v >= 10}

    def clusters(texts):
        size = {i: len(q) for i, q in texts.items() if len(q) >= 80}
        links = defaultdict(set)
        for (a, b), n in seeds(texts).items():
            if a in size and b in size and n + 15 >= 0.5 * size[b]:
                links[a].add(b)
        order = sorted(size, key=lambda i: (-size[i], i))
        return {i: i for i in order} | first_come(order, links)

    want = clusters(tables["seqs"])
    assert {int(a): int(b) for a, b in run("clu_c1_identity_clusters")} == want
    members, cons = Counter(want.values()), {}
    for f in members:
        rows = {i: tables["seqs"][i].replace("N", "-") for i in want if want[i] == f}
        if len(rows) == 1:
            cons[f] = tables["seqs"][f]
            continue
        width, out = max(map(len, rows.values())), ""
        for c in range(width):
            n = Counter(q[c] for q in rows.values() if c < len(q) and q[c] != "-")
            first = {b: min(i for i, q in rows.items() if q[c : c + 1] == b) for b in n}
            if n:
                b = min(n, key=lambda b: (-n[b], first[b]))
                out += b if n[b] > len(rows) // 2 else ""
        cons[f] = out
    again = clusters(cons)
    assert set(run("clu_c3_recluster")) == {(f, members[f], len(cons[f]), again.get(f, f)) for f in members}


# ---- models and series


def test_two_states_against_all_paths():
    from itertools import product

    m = hmm.model("ATCG", (1, 2), ((9, 1), (2, 8)), ((3, 3, 2, 2), (5, 4, 1, 1)))
    r = random.Random(5)
    for _ in range(30):
        s = "".join(r.choice("ATCGN") for _ in range(r.randint(1, 9)))

        def score(p, s=s):
            x = m.start[p[0]] + sum(m.go[a][b] for a, b in zip(p, p[1:]))
            return x + sum(m.emit[k]["ATCG".index(c)] for k, c in zip(p, s) if c != "N")

        got = tuple(hmm.best_path(s, m).tolist())
        assert score(got) == pytest.approx(max(score(p) for p in product((0, 1), repeat=len(s))))


def test_training_counts_along_paths(spark, run, tables):
    m = hmm.model("ATCGN", (1, 1), ((99, 1), (1, 99)), ((30, 30, 18, 18, 4), (38, 38, 10, 10, 4)))
    for _ in range(2):
        go, emit = [[1, 1], [1, 1]], [[1] * 5, [1] * 5]
        for q in tables["seqs"].values():
            p = hmm.best_path(q, m).tolist()
            for a, b in zip(p, p[1:]):
                go[a][b] += 1
            for a, c in zip(p, q):
                if c in "ATCGN":
                    emit[a]["ATCGN".index(c)] += 1
        m = hmm.model("ATCGN", (1, 1), go, emit)
    want = set()
    for i, q in tables["seqs"].items():
        p = hmm.best_path(q, m).tolist()
        for a in range(len(p)):
            if p[a] and (a == 0 or not p[a - 1]):
                b = next((x for x in range(a, len(p)) if not p[x]), len(p))
                want.add((i, a + 1, b))
    assert set(run("v15_two_state_path")) == want


def test_fuzzy_ends(run, tables):
    want = {}
    for i, q in tables["seqs"].items():
        if len(q) >= 60:
            got = search.fuzzy_spans(q[20:40], q)
            want[i] = (got[0][0], got[-1][1], len(got))
    assert {i: tuple(x) for i, *x in run("fn_f17_fuzzy_find")} == want and all(a <= 20 and b >= 40 for a, b, _ in want.values())


def test_differential_against_loops(spark):
    """Welch's t, adjustment per insert type and the choice of one row per gene."""
    import numpy as np

    from seqloom.functions.stats import t_two_sided
    from seqloom.plans import expression

    r = random.Random(21)
    data = defaultdict(list)
    for gene in range(40):
        for pos in ("No_Insertion", *expression.TYPES):
            shift = r.choice([0, 0, 40]) if pos != "No_Insertion" else 0
            for _ in range(r.choice([0, 1, 3, 6])):
                data[gene, pos].append(round(10 + shift + r.gauss(0, 2), 3))
    rows = [(g, f"s{k}", p, v) for (g, p), vs in data.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "gene long, sample string, position string, value double")
    mean = lambda x: sum(x) / len(x)
    var = lambda x: sum((v - mean(x)) ** 2 for v in x) / (len(x) - 1)
    tests = {}
    for (g, p), x in data.items():
        base = data.get((g, "No_Insertion"), [])
        if p == "No_Insertion" or not x:
            continue
        fold = np.log2(mean(x) + 1) - np.log2(mean(base) + 1) if base else None
        pv = None
        if len(x) > 1 and len(base) > 1:
            a, b = var(x) / len(x), var(base) / len(base)
            dof = (a + b) ** 2 / (a * a / (len(x) - 1) + b * b / (len(base) - 1))
            pv = float(t_two_sided(np.array([(mean(x) - mean(base)) / (a + b) ** 0.5]), np.array([dof]))[0])
        tests[g, p] = (fold, pv)
    adjusted = {}
    for p in expression.TYPES:
        ps = sorted((v[1], k) for k, v in tests.items() if k[1] == p and v[1] is not None)
        low = 1.0
        for rank in range(len(ps), 0, -1):
            low = min(low, ps[rank - 1][0] * len(ps) / rank)
            adjusted[ps[rank - 1][1]] = low
    want = {}
    for g in range(40):
        mine = [(not (k in adjusted and abs(v[0]) > 1 and adjusted[k] < 0.05), expression.TYPES.index(k[1]), k) for k, v in tests.items() if k[0] == g]
        if mine:
            plain, _, k = min(mine)
            if tests[k][0] is not None and adjusted.get(k, 0) > 0:
                want[g] = (k[1], tests[k][0], adjusted[k], not plain, "ns" if plain else "up" if tests[k][0] > 0 else "down")
    got = {x.gene: tuple(x)[1:] for x in expression.differential(df).collect()}
    assert got.keys() == want.keys() and any(v[3] for v in want.values())
    for g in want:
        assert got[g][0] == want[g][0] and got[g][3:] == want[g][3:] and got[g][1:3] == pytest.approx(want[g][1:3], rel=1e-6)
