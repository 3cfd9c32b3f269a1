import math
import random
import re
from collections import Counter

from churnkit.llm import licenses as L
from llm_text import frame  # noqa: F401


def slow(rows):
    """(path, (cosine, -template, licence) or None, licence file by its text) of each row, segment by segment."""
    docs = [(p, t or "") for p, t in rows]
    n = len(docs)
    words_of = lambda t: re.findall(L.TERM, t.lower())
    df = Counter(w for _, t in docs for w in set(words_of(t)))
    idf = lambda w: math.log((n + 1) / (df[w] + 1)) + 1
    every = [*L.TEMPLATES, *L.FILE_TEMPLATES, *L.FILE_OPENINGS]
    files = range(len(L.TEMPLATES), len(L.TEMPLATES) + len(L.FILE_TEMPLATES))

    def vector(words):
        return {w: k * idf(w) for w, k in Counter(words).items()}

    def cosine(a, b):
        dot = sum(x * b.get(w, 0) for w, x in a.items())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if dot else 0

    vectors = [vector(words_of(t)) for _, t in every]
    needed = []  # terms without which a template can't be reached
    for v in vectors:
        total = rest = sum(x * x for x in v.values())
        need = set()
        for w in sorted(v, key=lambda w: -idf(w)):
            if math.sqrt(rest / total) < L.MIN_COSINE:
                break
            need.add(w)
            rest -= v[w] ** 2
        needed.append(need)
    anchors = set().union(*needed)

    out = []
    for p, t in docs:
        words, lines, met = words_of(t), t.lower().split("\n"), []
        marked = [any(re.search(rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])", x) for a in anchors) for x in lines]
        for i in range(len(lines)):
            for k in range(1, L.LINES + 1):
                if i + k <= len(lines) and all(marked[i:i + k]):
                    met += [(words_of(" ".join(lines[i:i + k])), j, None) for j in range(len(every))]
        for j, (_, text) in enumerate(every):
            mine = words_of(text)
            for i, w in enumerate(words):
                for q, x in enumerate(mine):
                    if w == x and w in needed[j]:
                        at = max(0, i - q)
                        for size in (len(mine), 2 * len(mine)):
                            hits = [k for k, y in enumerate(words[at:at + size]) if y in vectors[j]]
                            if hits:
                                met.append((words[at + hits[0]:at + hits[-1] + 1], j, at + hits[0]))
        best, grants = None, False
        for seg, j, at in {(tuple(x), j, at) for x, j, at in met}:
            c = cosine(vector(seg), vectors[j])
            if c < L.MIN_COSINE:
                continue
            best = max(best or (0,), (round(c, 9), -j, every[j][0]))
            both = sum((Counter(seg) & Counter(words_of(every[j][1]))).values())
            grants |= j in files and both >= L.FILE_SHARE * len(re.findall(L.WORD, t))
            grants |= j >= files.stop and at is not None and at <= L.FILE_HEAD and round(c, 9) >= L.FILE_COSINE
        out.append((p, best, grants))
    return out


def test_own_licences_against_brute_force(frame):
    rows = [("a/b/x.py", "# Licensed under the Apache License, Version 2.0.\ncode here that is longer than the notice above it"), ("a/LICENSE", L.TEMPLATES[7][1]),
            ("a/b/c/y.txt", "nothing of the kind"), ("z.txt", None), ("q/r/s.txt", "words\nReleased under the MIT License.\nmore words than the notice itself has"),
            ("q/COPYING.txt", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\nany later version"),
            ("q/t/u.txt", "the license of the software and the conditions"), ("w/v.txt", "Licensed under CC BY-NC 4.0."), ("w/k/k.txt", ""), (None, "Released under the MIT License")]
    df = frame([(i, t, p) for i, (p, t) in enumerate(rows)]).withColumnRenamed("source", "path")
    got = {r.path: r for r in L.scan(df).collect()}
    assert len(got) == len(rows)
    for path, best, grants in slow(rows):
        assert got[path].own_licence == (best[2] if best else None)
        assert best is None or math.isclose(got[path].cosine, best[0], abs_tol=1e-5)
        assert path is None or got[path].licence_file == (grants or bool(best and re.match(L.LICENCE_FILE, path.split("/")[-1])))
    assert got["a/LICENSE"].licence_file and got["q/COPYING.txt"].licence_file and not got["w/v.txt"].licence_file
    assert not got["q/r/s.txt"].licence_file
    assert (got["a/b/c/y.txt"].licence, got["a/b/c/y.txt"].inherited_from) == (got["a/LICENSE"].own_licence, "a")
    assert (got["q/t/u.txt"].licence, got["q/t/u.txt"].inherited_from) == ("GPL-3.0", "q")
    assert (got["w/v.txt"].own_licence, got["w/k/k.txt"].licence, got["w/k/k.txt"].inherited_from) == ("CC-BY-NC-4.0", None, None)
    assert got["a/b/x.py"].licence == "Apache-2.0" and got["a/b/x.py"].inherited_from is None
    assert got["z.txt"].licence is None and got[None].inherited_from is None


def test_the_nearest_directory_wins_and_ties_are_settled(frame):
    mit, gpl = "Released under the MIT License", L.TEMPLATES[6][1]
    rows = [("LICENSE", gpl), ("d/LICENSE", mit), ("d/e/f/g.txt", "x"), ("h/i.txt", "x"), ("d/x.txt", "x"), ("t/LICENSE.a", gpl), ("t/LICENSE.b", mit), ("t/u.txt", "x"),
            ("t/u.txt", "x")]
    df = frame([(i, t, p) for i, (p, t) in enumerate(rows)]).withColumnRenamed("source", "path")
    got = [(r.path, r.licence, r.inherited_from) for r in L.scan(df).collect()]
    assert ("d/e/f/g.txt", "MIT", "d") in got and ("h/i.txt", "GPL-3.0", "") in got and ("d/x.txt", "MIT", "d") in got
    assert got.count(("t/u.txt", "GPL-3.0", "t")) == 2


def test_other_words_weigh_the_same_at_any_table_size(frame):
    rows = [("a", "Released bitte under the MIT hinweis License"), ("b", "bitte the hinweis of it"), ("c", "bitte hinweis the"), ("d", "the and of")]
    got = []
    for times in (2, 400):
        df = frame([(k, t, p) for k in range(times) for p, t in rows]).withColumnRenamed("source", "path")
        got += L.scan(df).where("path = 'a'").select("own_licence", "cosine").distinct().collect()
    assert [r.own_licence for r in got] == ["MIT", "MIT"]
    assert abs(got[0].cosine - got[1].cosine) < 0.05 and got[1].cosine > 0.75


def test_notices_in_paragraphs_and_over_many_lines(frame):
    gpl = L.TEMPLATES[7][1].split()
    paragraph = "alpha beta gamma delta " * 12
    rows = [("a/1", f"{paragraph}This work is licensed under the GNU General Public License, version 3. {paragraph}"),
            ("b/1", "\n".join(" ".join(gpl[i:i + 3]) for i in range(0, len(gpl), 3)) + f"\n{paragraph}"), ("c/1", paragraph)]
    df = frame([(i, t, p) for i, (p, t) in enumerate(rows)]).withColumnRenamed("source", "path")
    got = {r.path: (r.own_licence, r.licence_file) for r in L.scan(df).collect()}
    assert got == {"a/1": ("GPL-3.0", False), "b/1": ("GPL-3.0", False), "c/1": (None, False)}


def test_whole_licence_texts_grant_to_their_directory(frame):
    wrap = lambda t, k: "\n".join(" ".join(t.split()[i:i + k]) for i in range(0, len(t.split()), k))
    mit, gpl = L.FILE_TEMPLATES[0][1], L.FILE_OPENINGS[1][1]
    rows = [("m/1", "MIT License\n\nCopyright (c) 2021 A. Holder\n\n" + wrap(mit, 12)), ("m/2", "x"), ("g/1", wrap(gpl, 9) + "\nother words of the preamble " * 80), ("g/2", "x"),
            ("h/1", wrap(mit, 12) + "\n" + "code of some program goes on " * 200), ("h/2", "x")]
    df = frame([(i, t, p) for i, (p, t) in enumerate(rows)]).withColumnRenamed("source", "path")
    got = {r.path: (r.licence, r.licence_file, r.inherited_from) for r in L.scan(df).collect()}
    assert got["m/1"] == ("MIT", True, None) and got["m/2"] == ("MIT", False, "m")
    assert got["g/1"] == ("GPL-3.0", True, None) and got["g/2"] == ("GPL-3.0", False, "g")
    assert got["h/1"] == ("MIT", False, None) and got["h/2"] == (None, False, None)


def test_segments_with_foreign_words_against_brute_force(frame):
    """Notices, whole files and openings with words of no template in, before and after them."""
    rng = random.Random(6)
    odd = ["bitte", "hinweis", "x1", "the", "of", "zeta", "q-r", "code"]
    rows = []
    for k, (_, t) in enumerate([*L.TEMPLATES[::2], *L.FILE_TEMPLATES[1:2], *L.FILE_OPENINGS[:2]]):
        words = t.split()
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words)), rng.choice(odd))
        if k % 3 == 0:
            words = [*rng.choices(odd, k=rng.choice([3, 15, 60])), *words, *rng.choices(odd, k=20)]
        if k % 4 == 1:
            words = [w + ("\n" if rng.random() < 0.2 else "") for w in words]
        rows.append((f"d{k}/f", " ".join(words)))
    rows += [(f"e/{k}", " ".join(rng.choices(odd + ["license", "software", "under"], k=30))) for k in range(6)]
    df = frame([(i, t, p) for i, (p, t) in enumerate(rows)]).withColumnRenamed("source", "path")
    got = {r.path: r for r in L.scan(df).collect()}
    for path, best, grants in slow(rows):
        assert got[path].own_licence == (best[2] if best else None), path
        assert best is None or math.isclose(got[path].cosine, best[0], abs_tol=1e-5)
        assert got[path].licence_file == grants
    assert sum(r.own_licence is not None for r in got.values()) > 8


def test_a_notice_line_grants_nothing(frame):
    """Whatever the table's size, rows beside a short document with a notice don't inherit."""
    for n in (4, 60):
        rows = [("s/en/1", "two words\nThis work is licensed under the GNU General Public License, version 3"), *[(f"s/en/{k}", f"text number {k}") for k in range(2, n)]]
        df = frame([(i, t, p) for i, (p, t) in enumerate(rows)]).withColumnRenamed("source", "path")
        got = L.scan(df).collect()
        assert sum(r.inherited_from is not None for r in got) == 0 and sum(r.own_licence == "GPL-3.0" for r in got) == 1


def test_empty(frame):
    assert L.scan(frame([(1, "x", "p")]).where("doc_id < 0").withColumnRenamed("source", "path")).collect() == []


def test_no_python_in_the_plan(frame):
    df = frame([(1, "Released under the MIT License", "p")]).withColumnRenamed("source", "path")
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
