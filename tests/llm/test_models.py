"""Operators that learn, pack or detect, by held-out accuracy, exact round trips and planted cases."""

import json
import random
import zlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.llm import licences, linear, media, packing, pictures, quality, tokens, toxicity


def labelled(spark, n=700):
    """Toxic texts name a group and insult it; either alone is harmless. Poor texts shout or repeat themselves."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 6)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        insult, group, poor = rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.3
        for on, w in ((insult, "dunderheads"), (group, "zorblaxians")):
            if on:
                words.insert(rng.randrange(len(words)), w)
        text = " ".join(words)
        docs.append((i, text.upper() + "!!" if poor else text + "."))
        labels.append((i, int(not poor), int(insult and group)))
    return rows(spark, [*docs, (None, "x"), (9000, None), (9001, ""), (9002, "y " * 60_000)]), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (6, 7, 7)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator,label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, operator, label, none):
    docs, labels = labelled(spark)
    scored = operator.score(docs, labels).cache()
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    got = linear.accuracy(scored, labels.where("doc_id < 700 and doc_id not in (5, 6)"), label).first()
    assert got.rows > 80 and got.accuracy > 0.9 and got.recall_1 > 0.8
    assert operator.score(none, labels).count() == 0
    flat = operator.score(docs, labels.where("false"))
    assert flat.agg(F.countDistinct("score")).first()[0] == 1
    crc = {r.doc_id: r.held_out for r in scored.collect()}
    assert all(v == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0) for k, v in crc.items())


def test_pairs_say_what_no_term_says(spark):
    """Without the pairs' weights, the machine can't tell an insult from a group's name from both."""
    rng = random.Random(1)
    texts, y = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([f"f{rng.randrange(40)}" for _ in range(10)] + ["insult"] * a + ["group"] * b))
        y.append(float(a == b))  # no term goes with the label by itself
    for feats in (linear.Features(18, words=(1,)), linear.Features(18, words=(1,), stems=True)):  # the latter as op2 has it
        m = linear.FactorizationMachine.fit(texts, np.array(y), feats)
        assert ((m.score(texts) >= 0.5) == np.array(y)).mean() > 0.95
        flat = linear.FactorizationMachine(feats, m.places, m.w, m.v * 0, m.bias)
        assert ((flat.score(texts) >= 0.5) == np.array(y)).mean() < 0.8


def small_texts(n=90):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n)]
    return texts, np.array([float("a" in t and "b" in t) for t in texts])


def terms_of(feats, texts):
    return [dict(zip(*np.unique(feats.of([t])[0], return_counts=True))) for t in texts]


def test_quality_model_is_ftrl_written_out():
    texts, y = small_texts()
    feats = linear.Features(10, words=(1, 2))
    m = linear.Logistic.fit(texts, y, feats, epochs=3, batch=4)
    alpha, beta, l1, l2 = 0.3, 1.0, 0.05, 0.5
    z, n, z0 = {}, {}, linear.prior(y)
    x = [{**{k: c / np.sqrt(sum(d.values())) for k, c in d.items()}, "bias": 1.0} for d in terms_of(feats, texts)]

    def w(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= l1 else (np.sign(v) * l1 - v) / ((beta + np.sqrt(n.get(k, 0.0))) / alpha + l2)

    rng = np.random.default_rng(7)
    for _ in range(3):
        order = rng.permutation(len(y))
        for start in range(0, len(y), 4):
            some = order[start : start + 4]
            weights = {k: w(k) for i in some for k in x[i]}
            error = {i: linear.sigmoid(z0 + sum(weights[k] * v for k, v in x[i].items())) - y[i] for i in some}
            for k in weights:
                g = sum(x[i].get(k, 0) * error[i] for i in some)
                z[k] = z.get(k, 0) + g - (np.sqrt(n.get(k, 0) + g * g) - np.sqrt(n.get(k, 0))) / alpha * weights[k]
                n[k] = n.get(k, 0) + g * g
    assert m.bias == pytest.approx(w("bias") + z0, abs=1e-5)
    assert all(m.weights[k] == pytest.approx(w(k), abs=1e-5) for k in z if k != "bias") and np.count_nonzero(m.weights) > 5


def test_toxicity_model_is_a_factorization_machine_written_out():
    texts, y = small_texts()
    feats = linear.Features(10, words=(1,))
    m = linear.FactorizationMachine.fit(texts, y, feats, epochs=3, steps=1, batch=16, sure=-1.0, terms=8)
    places = m.places.tolist()
    x = [[places.index(k) for k in d if k in places] for d in terms_of(feats, texts)]
    rng = np.random.default_rng(11)
    w, v = np.zeros(8), rng.normal(0, 0.05, (8, 8))
    bias, gw, gv, gb = linear.prior(y), np.full(8, 1e-2), np.full((8, 8), 1e-2), 1.0

    def value(t):
        return linear.sigmoid(bias + sum(w[i] for i in t) + sum(v[i] @ v[j] for a, i in enumerate(t) for j in t[:a]))

    for _ in range(3):
        order = rng.permutation(len(y))
        for start in range(0, len(y), 16):
            some = order[start : start + 16]
            error = {t: (value(x[t]) - y[t]) / len(some) for t in some}
            used = sorted({i for t in some for i in x[t]})
            d = {i: sum(error[t] for t in some if i in x[t]) for i in used}
            dv = {i: sum(error[t] * sum((v[j] for j in x[t] if j != i), np.zeros(8)) for t in some if i in x[t]) + 1e-3 * v[i] for i in used}
            for i in used:
                gw[i] += d[i] ** 2
                gv[i] += dv[i] ** 2
                step = 0.1 / np.sqrt(gw[i])
                new = w[i] - step * d[i]
                w[i] = np.sign(new) * max(0, abs(new) - step * 2e-3)
                v[i] = v[i] - 0.1 / np.sqrt(gv[i]) * dv[i]
            e = sum(error.values())
            gb += e * e
            bias -= 0.1 / np.sqrt(gb) * e
    assert len(places) == 8 and m.w == pytest.approx(w, abs=1e-5) and m.v == pytest.approx(v, abs=1e-5) and m.bias == pytest.approx(bias, abs=1e-5)
    assert m.score(texts) == pytest.approx([value(t) for t in x], abs=1e-5)


def test_labels_of_the_held_out_fifth_are_never_read(spark):
    docs, labels = labelled(spark, 200)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id or -1, r.score) for r in toxicity.score(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_keep_good(spark, none):
    docs, labels = labelled(spark, 300)
    kept = quality.keep_good(docs, labels)
    want = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert quality.keep_good(none, labels).count() == 0


ODD = ["", " ", "İstanbul ſ Σας ŉ Ǆ ǅ _a_b 12² it's I'LL 'S x'd", "naïvé é <|endoftext|> a", "tab\x0bvt \x1c fs em\xa0nb", "don't--'stop' ''s !'s 3rd", "日本語 テスト 🎉", "a\r\nb", "A" * 5000, "ÀÉÎõü ßẞ"]


def test_tokens_are_the_tokenizers(pairs):
    t = tokens.WordTokens(tokens.default_path(), limit=50)
    texts = ODD + [x for _, x in pairs if x]
    for part in (texts, texts[::-1], texts[:3]):
        want = [x.ids for x in t.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in t.encode(part)] == want


def test_every_letter_up_to_u024f_has_the_tokenizers_ids():
    """Alone, doubled, beside letters, digits, marks and capitals whose lower case lies beyond U+024F; then at random."""
    t, rng = tokens.WordTokens(tokens.default_path()), random.Random(2)
    forms = ("{0}", "{0}{0}", "a{0}", "{0}a", "a{0}B", "1{0}", "{0}1", "'{0}", "{0}'s", ".{0}.", "é{0} {0}", "Ə{0}Ɛ")
    texts = [f.format(chr(c)) for c in range(9, 0x250) for f in forms]
    letters = [chr(c) for c in range(9, 0x250)] + list(" \n'stredvml0123456789ABC") * 8
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(5000)]
    want = [x.ids for x in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in t.encode(texts)] == want


def check_pieces(got, texts, length=2048):
    t = tokens.WordTokens(tokens.default_path())
    left = {}
    for d, text in texts:
        ids = np.array(t.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        left.setdefault(d, []).append(ids)
    sequences, covered = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        covered.setdefault(r.doc_id, []).append(r)
    assert set(covered) == set(left)
    for d, pieces in covered.items():
        assert sum(p.length for p in pieces) == sum(map(len, left[d]))
        for p in pieces:
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in left[d])
        if len(left[d]) == 1:
            assert [a.start for a in sorted(pieces, key=lambda a: a.start)] == list(np.cumsum([0] + [a.length for a in sorted(pieces, key=lambda a: a.start)])[:-1])
    short = 0
    for s in sequences.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= length
        short += end < length
    return short


def test_packing(spark, docs, pairs, none, monkeypatch):
    got = packing.pack(docs).collect()
    assert check_pieces(got, pairs) <= 1
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5000)
    monkeypatch.setattr(packing, "SHARD_TOKENS", 10_000)
    assert check_pieces(packing.pack(docs).collect(), pairs) <= 4
    assert check_pieces(packing.pack(docs, length=64).collect(), pairs, 64) <= 4
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("dense", [1, 10, 10**9])
def test_scores_are_bm25(dense, monkeypatch):
    """By table, by postings, and by both, and after documents have left the index."""
    monkeypatch.setattr(packing, "DENSE", dense)
    rng = np.random.default_rng(5)
    texts = [rng.integers(2, 60, rng.integers(1, 80)).astype(np.uint16) for _ in range(90)]
    idf, mean = rng.random(1 << 16), 33.0
    idf[50:60] = 0
    index = packing._Index([packing._Left(i, x, 0) for i, x in enumerate(texts)], idf, mean)

    def plain(i, j):
        tf = lambda t: int((texts[j] == t).sum())
        return sum(idf[t] * tf(t) * 2.2 / (tf(t) + 1.2 * (0.25 + 0.75 * len(texts[j]) / mean)) for t in set(texts[i].tolist()))

    for i in (0, 7, 89):
        assert index.scores(i) == pytest.approx([plain(i, j) for j in range(90)], rel=1e-4)
    used = np.arange(90) % 3 == 1
    index.without(used)
    assert index.scores(2) == pytest.approx([0 if used[j] else plain(2, j) for j in range(90)], rel=1e-4)


def test_neighbours_share_terms(spark):
    """Texts of twenty topics, each with its own words: sequences mostly hold one topic."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    topics = [[word() for _ in range(60)] for _ in range(20)]
    pairs = [(i, " ".join(rng.choice(topics[i % 20]) for _ in range(60))) for i in range(400)]
    got = packing.pack(rows(spark, pairs)).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.doc_id % 20, r.length))
    pure = np.mean([max(sum(n for k, n in s if k == x) for x in range(20)) / sum(n for _, n in s) for s in by.values()])
    assert pure > 0.7


def test_licences(spark, none):
    files = [
        (1, "a/b/one.py", "import x\nLicensed under the Apache License, Version 2.0.\n"), (2, "a/b/two.py", "print()"), (3, "a/LICENSE", "Released under the MIT License.\nand more"),
        (4, "a/c/d/e.txt", "prose about apples"), (5, "z/f.txt", None), (6, "z/g.txt", ""), (None, None, "x"), (7, "top.txt", "The license of poets is long and old, as they say in many books."),
        (8, "q/k.txt", "Licensed under CC BY-NC 4.0."), (9, "q/r/l.txt", "nothing here"), (2, "a/b/two.py", "print()"), (10, "a/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (11, "a/c/long.txt", "word " * 40_000 + "\nReleased under the MIT License."),
    ]
    df = spark.createDataFrame([(d, p, t, "x", "y") for d, p, t in files], "doc_id long, path string, text string, folder string, own string")
    got = {(r.doc_id, r.path): (r.own, r.licence, r.origin) for r in licences.scan(df).collect()}
    assert got[1, "a/b/one.py"] == ("Apache-2.0", "Apache-2.0", "own") and got[2, "a/b/two.py"] == (None, "MIT", "/a") and got[3, "a/LICENSE"][0] == "MIT"
    assert got[4, "a/c/d/e.txt"] == (None, "GPL-3.0", "/a/c") and got[5, "z/f.txt"] == got[6, "z/g.txt"] == got[7, "top.txt"] == (None, None, None)
    assert got[8, "q/k.txt"][0] == "CC-BY-NC-4.0" and got[9, "q/r/l.txt"] == (None, "CC-BY-NC-4.0", "/q") and got[11, "a/c/long.txt"][0] == "MIT"
    assert licences.scan(df).count() == len(files) and licences.scan(df.where("false")).count() == 0


APACHE = """/*
 * Copyright 2020 Somebody
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance
 * with the License. You may obtain a copy of the License at
 */
code();"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.

code()"""
MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies."""
BSD = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
"""
TITLE = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007\n\n" + "Everyone may copy it. " * 400


def test_wrapped_headers_and_licence_files(spark):
    files = [(1, "a/x.c", APACHE), (2, "a/x.py", GPL), (3, "m/LICENSE.txt", MIT), (4, "m/y.py", "y"), (5, "b/z.cc", BSD), (6, "g/COPYING", TITLE), (7, "g/h/i.c", "i"), (8, "n/o.c", "// Nothing here\n// of the kind, by permission\n")]
    got = {r.doc_id: (r.own, r.licence) for r in licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    want = {1: "Apache-2.0", 2: "GPL-3.0", 3: "MIT", 4: None, 5: "BSD-3-Clause", 6: "GPL-3.0", 7: None, 8: None}
    assert {k: own for k, (own, _) in got.items()} == want and got[4][1] == "MIT" and got[7][1] == "GPL-3.0"


def test_licence_cosine_is_that_of_tf_idf(spark):
    texts = ["Released under the MIT License.", "Some prose. Licensed under the Apache License, Version 2.0.", "more words of no interest", "This work is licensed under CC BY 4.0 today."]
    got = {r.doc_id: (r.own, r.cosine) for r in licences.scan(spark.createDataFrame([(i, f"d/{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string"), least=0.1).collect()}
    import re

    split = lambda t: [x for x in re.split(r"[^a-z0-9.]+|[.](?![0-9])", t.lower()) if x]
    vocabulary = {w for _, t in licences.TEMPLATES for w in split(t)}
    n = len(texts)
    df = {w: sum(w in split(t) for t in texts) for w in vocabulary}
    idf = lambda w: np.log((n + 1) / (df[w] + 1)) + 1 if w in vocabulary else np.log(n + 1) + 1
    vec = lambda t: {w: split(t).count(w) * idf(w) for w in split(t)}

    def cosine(a, b):
        a, b = vec(a), vec(b)
        return sum(v * b.get(w, 0) for w, v in a.items()) / np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    for i, unit in ((0, texts[0]), (1, "Licensed under the Apache License, Version 2.0."), (3, texts[3])):
        best = max((round(float(cosine(unit, t)), 6), name) for name, t in licences.TEMPLATES)
        assert got[i] == (best[1], pytest.approx(best[0], abs=2e-6))


def test_pictures_round_trip():
    x = pictures.draw(7, 1)
    assert (media.decode(media.encode_png(x)) == x).all()
    ppm = b"P6 2 1 255\n" + bytes([0, 3, 6, 9, 9, 9])
    assert media.decode(ppm).tolist() == [[3, 9]]
    assert [media.decode(b) for b in (None, b"", b"\x89PNG\r\n\x1a\nxx", b"P5 9 9 255\nabc", b"GIF89a", b"P5 0 0 255\nx", b"P5 1 1 999\nxx")] == [None] * 7
    assert media.decode(media.encode_png(np.zeros((3, 0), np.uint8))) is None
    assert media.decode(b"P5\n# by hand\n3 1\n255\n" + bytes([32, 9, 13])).tolist() == [[32, 9, 13]]


def test_png_kinds():
    def png(head, *parts):
        chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(head)) + b"".join(chunk(*p) for p in parts) + chunk(b"IEND", b"")

    size = [0, 0, 0, 2, 0, 0, 0, 1]
    palette = png([*size, 8, 3, 0, 0, 0], (b"PLTE", bytes([0, 0, 0, 30, 60, 90])), (b"IDAT", zlib.compress(bytes([0, 1, 0]))))
    assert media.decode(palette).tolist() == [[60, 0]]
    assert media.decode(png([*size, 16, 0, 0, 0, 0], (b"IDAT", zlib.compress(bytes([0, 7, 128, 9, 0]))))).tolist() == [[7.5, 9]]
    assert media.decode(png([*size, 8, 0, 0, 0, 1], (b"IDAT", zlib.compress(bytes([0, 7, 9]))))) is None
    assert media.decode(png([*size, 8, 3, 0, 0, 0], (b"PLTE", bytes(3)), (b"IDAT", zlib.compress(bytes([0, 1, 0]))))) is None


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    x = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    raw, above = b"", np.zeros(21, int)
    for row in x.reshape(5, 21).astype(int):
        left = np.concatenate([[0, 0, 0], row[:-3]])
        corner = np.concatenate([[0, 0, 0], above[:-3]])
        p = left + above - corner
        paeth = [min((a, b, c), key=lambda v, q=q: abs(q - v)) for a, b, c, q in zip(left, above, corner, p)]
        guess = [0 * row, left, above, (left + above) // 2, np.array(paeth)][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    assert (media._unfiltered(raw, 5, 7, 3).reshape(5, 7, 3) == x).all()


def test_image_copies(spark):
    scenes = {i: (i // 4, (0, 1, 2, 4)[i % 4]) for i in range(24)}
    pics = [(i, media.encode_png(pictures.draw(1000 + s, v + 5 * i if v == 1 else v))) for i, (s, v) in scenes.items()]
    pics += [(100, pics[0][1]), (101, None), (102, b"no picture"), (None, pics[4][1]), (100, pics[0][1])]
    df = spark.createDataFrame([(i, p, "x", 1) for i, p in pics], "image_id long, picture binary, corner string, bucket int")
    got = {r.image_id: r.class_id for r in media.copies(df).collect()}
    assert media.copies(df).count() == len(pics)
    for i, (s, _) in scenes.items():
        assert got[i] == (None if s == 1 else s * 4)
    assert got[100] == 0 and got[101] == 101 and got[102] == 102 and got[None] is None
    assert media.copies(df.where("false")).count() == 0


def test_windows_take_every_neighbour_before_others(spark):
    """A seed with many rare terms of its own, and more short neighbours than are looked at together, by terms of a third
    of all documents: its window holds no others, though these are shorter."""
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    shared, own, other = ([word(x) for _ in range(n)] for x, n in (("abcde", 12), ("fghij", 60), ("uvwxyz", 400)))
    texts = [" ".join([*shared, *own] * 2)]
    texts += [" ".join(rng.sample(shared, 6)) for _ in range(150)]
    texts += [" ".join(rng.sample(other, 2)) for _ in range(300)]
    got = packing.pack(rows(spark, list(enumerate(texts)))).collect()
    window = [r for r in got if r.sequence_id == next(x.sequence_id for x in got if x.doc_id == 0)]
    assert sum(r.length for r in window) == packing.LENGTH and len(window) > 64 and max(r.doc_id for r in window) <= 150


def test_scenes_depend_on_the_vector_alone(spark):
    """However far their ids lie apart, and so that copies grow with the table."""
    vector = [(-1.0) ** i * (i % 3 + 1) for i in range(64)]
    df = spark.createDataFrame([(i * 5, vector) for i in (0, 1, 1000, 10**9)], "vec_id long, embedding array<double>")
    assert len({r.picture for r in pictures.pictures(df).collect()}) == 1


def test_classes_are_those_of_all_pairs(spark):
    """As if each two pictures were matched over all table values, whoever else has them."""
    drawn = {i: pictures.draw(2000 + i // 9, i % 9 if i % 9 < 5 else 5 * i + 1) for i in range(63)}
    found = {i: media.describe(x.astype(float)) for i, x in drawn.items()}
    root, links = {i: i for i in drawn}, 0
    for a in drawn:
        for b in range(a):
            (pa, ca), (pb, cb) = found[a], found[b]
            i, j = np.nonzero((ca[:, None] == cb).any(-1))
            if len(i) and media.explained(pa[i], pb[j]) >= media.LEAST:
                links += 1
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    df = spark.createDataFrame([(i, media.encode_png(x)) for i, x in drawn.items()], "image_id long, picture binary")
    assert {r.image_id: r.class_id for r in media.copies(df.repartition(3)).collect()} == root and links > 150


def test_a_star_meets_each_row_once_and_classes_meet_each_other():
    rng = np.random.default_rng(4)
    bucket, node = rng.integers(0, 9, 200).astype(np.uint64), rng.integers(0, 30, 200)
    root = node // 4
    for star in (True, False):
        order, start, many = media.meetings(bucket, node, root, star)
        got = sorted((int(a), int(b)) for p in range(200) for q in range(start[p], start[p] + many[p]) for a, b in [sorted((order[p], order[q]))])
        mixed = media.mix(node.astype(np.int64).view(np.uint64))
        head = {b: node[bucket == b][np.argmin(mixed[bucket == b])] for b in set(bucket.tolist())}
        pairs = [(a, b) for a in range(200) for b in range(a + 1, 200) if bucket[a] == bucket[b]]
        want = [(a, b) for a, b in pairs if ((node[a] == head[bucket[a]]) != (node[b] == head[bucket[b]]) if star else root[a] != root[b])]
        assert got == want
    assert [len(x) for x in media.meetings(bucket[:0], node[:0], root[:0], True)] == [0, 0, 0]


def test_turned_and_scaled_copies_agree():
    a = pictures.draw(5, 0).astype(float)
    for b in (np.rot90(a), media._blurred(a, 1)[::2, ::2], a[10:, 5:] * 0.7 + 10, np.random.default_rng(1).normal(a, 4)):
        (pa, ca), (pb, cb) = media.describe(a), media.describe(b)
        i, j = np.array([(i, j) for i in range(len(ca)) for j in range(len(cb)) if (ca[i] == cb[j]).any()]).reshape(-1, 2).T
        assert media.explained(pa[i], pb[j]) >= media.LEAST


def test_pipeline(spark, tiny, tmp_path):
    import brute
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = {}
    for name, stage in c.STAGES:
        out = stage(spark, docs, tiny)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()] if name != "packing" else docs.collect()
        pairs = [(r.doc_id, r.text) for r in before.collect()]
        if name == "quality":
            good = {r.doc_id for r in spark.read.parquet(f"{tiny}/labels.parquet").where("quality = 1").collect()}
            assert good <= {d for d, _ in kept[name]} or len(good - {d for d, _ in kept[name]}) <= 2
        if name == "lines":
            assert sorted((d, brute.sha(t)) for d, t in kept[name]) == sorted((d, h) for d, _, _, h in brute.line_dedup(pairs))
        if name == "near_duplicates":
            assert sorted(d for d, _ in kept[name]) == sorted({c for _, c in brute.near_duplicates(pairs)})
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
            assert sorted(d for d, _ in kept[name]) == sorted(w[0] for w in brute.decontaminate(pairs, items) if not w[5])
    assert check_pieces(kept["packing"], kept["decontamination"]) <= 1
    whole = c.run(spark, tiny)
    assert json.dumps(sorted(map(tuple, whole.collect()))) == json.dumps(sorted(map(tuple, kept["packing"])))


def odd_folder(spark, path, docs):
    """Tables of a pipeline with odd documents: extra columns, no ids, repeated rows, null, empty and very long texts."""
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(100)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, "passage that no text has " * 4), (None, None), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_stages_on_odd_tables(spark, docs, pairs, tmp_path):
    import brute
    import corpus_pipeline as c

    folder = odd_folder(spark, tmp_path / "odd", docs)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {(r.doc_id, r.score) for r in quality.score(docs, labels).where("score >= 0.3").collect()}
    kept = c.quality_filter(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() >= len({d for d, _ in good})
    lines = c.line_dedup(spark, docs, folder)
    assert lines.columns == docs.columns and lines.count() == len(pairs)
    assert sorted(brute.sha(r.text or "") for r in lines.collect()) == sorted(h for *_, h in brute.line_dedup(pairs))
    near = c.near_dedup(spark, docs, folder)
    assert near.columns == docs.columns and len({r.text for r in near.collect()}) == near.count() <= len({t for _, t in pairs})
    clean = c.decontamination(spark, docs, folder)
    assert clean.columns == docs.columns and clean.count() == len(pairs)
    assert check_pieces(c.packed(spark, docs, folder).collect(), pairs) <= 1


def test_pipeline_of_no_documents(spark, none, tmp_path):
    import corpus_pipeline as c

    assert c.run(spark, odd_folder(spark, tmp_path / "none", none)).count() == 0
