"""The whole pipeline on planted rows, against code that shares nothing with the operators."""

import random
import re

import corpus_pipeline
from foliospark.llm import pieces


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text)


def folded(text):
    return re.findall("[a-z0-9]+", text.lower())


def shingles(text):
    w = [x.lower() for x in words_of(text)]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}


def expected(docs, items):
    # Quality: too short, or mostly repeated.
    kept = []
    for i, t in docs:
        w = words_of(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w):
            kept.append((i, t))
    # Near duplicates: the smallest id of each component.
    sets = {i: shingles(t) for i, t in kept}
    above = {i: i for i in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                above[max(root(a), root(b))] = min(root(a), root(b))
    kept = [(i, t) for i, t in kept if root(i) == i]
    # Decontamination: words in windows of items are cut; a text that is mostly such words goes.
    windows = {tuple(w[k : k + 10]) for w in map(folded, items) for k in range(len(w) - 9)}
    out = []
    for i, t in kept:
        places = [m.span() for m in re.finditer("[A-Za-z0-9]+", t)]
        w = folded(t)
        hit = sorted({k + j for k in range(len(w) - 9) if tuple(w[k : k + 10]) in windows for j in range(10)})
        if len(hit) > 0.5 * len(w):
            continue
        new, at, k = "", 0, 0
        while k < len(hit):
            last = k
            while last + 1 < len(hit) and hit[last + 1] == hit[last] + 1:
                last += 1
            new += t[at : places[hit[k]][0]]
            at = places[hit[last]][1]
            k = last + 1
        new += t[at:]
        # Personal data: the planted kinds stand alone between spaces.
        new = re.sub(r"[a-z]+@[a-z]+\.org", "<EMAIL>", new)
        new = re.sub(r"\+1 \(\d{3}\) 555-\d{4}", "<PHONE>", new)
        new = re.sub(r"(?<= )10\.\d+\.\d+\.\d+(?= )", "<IP>", new)
        out.append((i, new))
    return sorted(out)


def test_run(spark, tmp_path):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 8))) for _ in range(4000)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [" ".join(some(14)) for _ in range(5)]
    docs = []
    for k in range(30):
        w = some(rnd.randint(70, 160))
        if k % 3 == 0:
            w[20:20] = ["Mail", f"{rnd.choice(vocabulary)}@host.org", "or", f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}", "from", f"10.{k}.7.9", "now"]
        if k % 4 == 0:
            w[40:40] = items[k % 5].split()
        docs.append(" ".join(w))
    docs += [docs[k] for k in (1, 4, 4, 7)]  # exact copies
    for k in (2, 5, 9):  # near copies: one word changed in a long text
        w = docs[k].split()
        w[len(w) // 2] = "changed"
        docs.append(" ".join(w))
    docs += [" ".join(some(20)), "again and again " * 40, "", None, items[0] + " " + " ".join(some(8)) + " " + items[1] + " " + items[2]]  # all but the last too short or repeated
    rows = list(enumerate(docs))
    rnd.shuffle(rows)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted((r.doc_id, r.text) for r in pieces.decode(made).collect())
    want = expected(sorted(rows), items)
    assert [i for i, _ in got] == [i for i, _ in want] and got == want
    assert len(want) < len(docs) - 8 and any("<EMAIL>" in t for _, t in want)
