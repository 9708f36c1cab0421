"""Documents that are a licence file."""

from planlab.llm import licences

HEADS = {"MIT": "MIT License\n\nCopyright (c) 2021 A. Person\n\n", "ISC": "Copyright 2004 B\n\n", "Zlib": "zlib License\n\n(C) 1995 J. and M.\n\n",
         "BSD-2-Clause": "Copyright (c) 2011, C\nAll rights reserved.\n\n", "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) 2011, C\n\n", "Unlicense": ""}
STARTS = {"MIT": "permission is hereby granted free of charge", "ISC": "permission to use copy modify and", "Zlib": "this software is provided as is without",
          "BSD-2-Clause": "redistribution and use in source", "BSD-3-Clause": "redistribution and use in source", "Unlicense": "this is free and unencumbered"}


def test_whole_files(spark):
    bodies = {}
    for name, text in licences.KNOWN:
        if len(text) > 500:
            bodies.setdefault(name, text.strip())
    rows = [(i, HEADS[n] + bodies[n].replace(" ", "\n ", 40)) for i, n in enumerate(HEADS) if n in bodies]
    rows.append((99, HEADS["MIT"] + bodies.get("MIT", "").replace("sublicense", "lend")))
    known = spark.createDataFrame(list(licences.KNOWN), "licence string, text string")
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {**dict(enumerate(HEADS)), 99: None}
    plain = {r[0]: r[1] for r in spark.createDataFrame(list(bodies.items()), "n string, t string").select("n", licences.canonical(licences.F.col("t"))).collect()}
    assert all(plain[n].startswith(s) for n, s in STARTS.items())
