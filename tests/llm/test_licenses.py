"""Licence scans: headers, licence files, identifiers, the root directory, repeated rows."""

import pytest
from pyspark.sql import functions as F

from pageloom.llm import licenses

YEAR = "Copyright (c) 2021 Jo Example"
MIT = f"MIT License\n\n{YEAR}\n\n{licenses._MIT}\n\n{licenses._MIT_REST}\n\nTHE SOFTWARE {licenses._AS_IS.upper()}\n"
APACHE = "/*\n * " + (licenses._APACHE + "\n\n" + licenses._APACHE_REST).replace("\n", "\n * ") + "\n */\nint x;"
CASES = {
    "mit file": (MIT, "MIT"),
    "mit without title": (MIT.split("\n\n", 1)[1], "MIT"),
    "bsd 3": (f"{YEAR}\nAll rights reserved.\n\n{licenses._BSD}\n\n{licenses._BSD_2}\n{licenses._BSD_3}\n\n{licenses._BSD_AS_IS}", "BSD-3-Clause"),
    "bsd 2": (f"{YEAR}\nAll rights reserved.\n\n{licenses._BSD}\n\n{licenses._BSD_2}\n\n{licenses._BSD_AS_IS}", "BSD-2-Clause"),
    "apache header": (APACHE, "Apache-2.0"),
    "apache file": ("                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE", "Apache-2.0"),
    "gpl 3 header": ("# " + licenses._GPL.format("General", "3").replace("\n", "\n# "), "GPL-3.0"),
    "gpl 2 header, wrapped": ("\n".join(licenses._GPL.format("General", "2").split(" ")), "GPL-2.0"),
    "lgpl header": (licenses._GPL.format("Lesser General", "2.1"), "LGPL-2.1"),
    "spdx": ("// SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0"),
    "spdx later": ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    "spdx in brackets": ("# SPDX-License-Identifier: (MIT OR GPL-2.0)", "MIT"),
    "spdx unknown": ("# SPDX-License-Identifier: Zlib", None),
    "spdx like": ("# SPDX-License-Identifier: MIT-0", None),
    "line": ("text\nReleased under the MIT License.\nmore", "MIT"),
    "plates": ("licence plates are made of metal here", None),
    "empty": ("", None),
    "null": (None, None),
}


def got(df, **more):
    return {r.path: (r.licence, r.origin, r.from_dir) for r in licenses.licences(df, **more).collect()}


def test_texts(spark):
    rows = [(i, f"d{i}/x", t) for i, (t, _) in enumerate(CASES.values())]
    found = got(spark.createDataFrame(rows, "doc_id long, path string, text string"))
    assert {k: found[f"d{i}/x"][0] for i, k in enumerate(CASES)} == {k: want for k, (_, want) in CASES.items()}


def test_directories(spark):
    rows = [
        (5, "LICENSE", MIT), (1, "src/a.c", "int a;"), (2, "src/gpl/COPYING.txt", CASES["gpl 3 header"][0]), (0, "src/gpl/own.c", APACHE),
        (3, "src/gpl/deep/b.c", None), (4, "src/gpl/c.c", ""), (4, "src/gpl/c.c", ""), (6, None, "x"), (None, "z.c", "y"), (7, "/abs.c", "q"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"licence": F.lit("clash"), "n": F.lit(1), "line": F.lit("x")})
    found = got(df)
    assert found["src/a.c"] == ("MIT", "inherited", "") and found["LICENSE"] == ("MIT", "own", None) and found["z.c"] == ("MIT", "inherited", "")
    assert found["src/gpl/deep/b.c"] == ("GPL-3.0", "inherited", "src/gpl") == found["src/gpl/c.c"]
    assert found["src/gpl/own.c"] == ("Apache-2.0", "own", None) and found["/abs.c"] == ("MIT", "inherited", "") and found[None] == (None, "none", None)
    assert licenses.licences(df).count() == len(rows)


@pytest.mark.parametrize("wording", ["Joe's licence, all rights reserved", "100% \\free; drop table"])
def test_any_wording(spark, wording):
    df = spark.createDataFrame([(1, "a", "licence: " + wording)], "doc_id long, path string, text string")
    assert got(df, templates={"own": (f"licence {wording}",)})["a"][0] == "own"
