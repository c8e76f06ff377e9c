import math
from collections import Counter

from quillgrid.llm import license_scan
from tests.llm.frames import awkward_documents, empty_documents, folded_words, lower


def brute(text, threshold=0.8):
    w = folded_words(text)
    starts, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += hits
        base |= {label} if hits else set()
    labels, best = set(base), 0.0
    for label, template, own in license_scan.TEMPLATES:
        t = set(license_scan.template_words(template))
        size = math.ceil(len(folded_words(lower(template))) / threshold - 1e-9)
        for i in range(max(1, len(w) - size + 1)):
            block = set(w[i : i + size])
            share = len(block & t) / len(t)
            if share >= threshold - 1e-9 and set(own.split()) <= block:
                labels.add(label)
                best = max(best, share)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else best


def check(frame):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    want = Counter((d, *brute(t)) for d, t in rows)
    assert Counter(tuple(r) for r in license_scan.scan(frame).collect()) == want


def test_awkward_rows(spark):
    check(awkward_documents(spark))


def test_licenses(spark):
    texts = [t.upper() if i % 2 else t for i, (_, t, _) in enumerate(license_scan.TEMPLATES)]
    texts += ["mit license mit license MIT\n license", "The MIT-License; apache license", "x general public license", "general public", "license", "mit licenſe", "Licensed under CC BY-NC", "released MIT under license", "words before\n\nThis work is licensed under the GNU General Public License, version 3.\nafter", "\nApache  License\n" * 3, "É mit license"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_wrapped_notices_and_near_misses(spark):
    notices = {
        "bsd": "Copyright x\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "mit": "Permission is hereby granted, free of charge, to any person\nobtaining a copy\n of this software and",
        "isc": "/* Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided",
        "gpl": "x " * 300 + "you can redistribute it and/or modify\nit under the terms of the GNU General\nPublic License as" + " y" * 300,
    }
    wrong = ["Licensed under CC BY 4.0", "permission is hereby granted to any person of this software free of fee charge a copy", "redistribution " + "z " * 20 + "and use in source and binary forms with or without modification are permitted", "with or without modification, are permitted in source and binary forms and use"]
    rows = [*notices.values(), *wrong, "This work is licensed under the GNU General Public License, version 3.", "\u0130\u212aMIT \u212a Released under the M\u0130T License", "released UNDER the mit licen\u017fe"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    check(frame)
    got = {r.doc_id: r.labels for r in license_scan.scan(frame).collect()}
    assert [got[i] for i in range(4)] == list(notices) and all(not got[4 + i] for i in range(len(wrong))) and got[8] == "gpl"


def test_empty(spark):
    assert license_scan.scan(empty_documents(spark)).count() == 0


def test_plan_has_no_python(spark):
    plan = license_scan.scan(awkward_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
