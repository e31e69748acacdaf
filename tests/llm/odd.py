"""Small tables with everything that an operator must stand: NULLs, blanks, ties, clashes."""

from __future__ import annotations

import random

LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def odd_documents(spark, extra: str = ""):
    """doc_id, text, and extra columns (a schema) filled with a constant or NULL."""
    rng = random.Random(7)
    body = [" ".join(rng.choice("alpha beta gamma delta rho tau".split()) + str(rng.randrange(40)) for _ in range(80)) for _ in range(6)]
    near = body[0].split()
    near[40] = "changed"
    rows = [
        (1, body[0]),
        (2, body[0]),
        (3, " ".join(near)),
        (4, "head\n" + body[1] + "\ntail"),
        (5, "other\n" + body[1] + "\nend"),
        (6, body[2]),
        (6, body[2]),
        (7, ""),
        (8, None),
        (9, " \n\t "),
        (10, "one two"),
        (11, "one  TWO"),
        (None, body[3]),
        (None, None),
        (12, LONG),
        (13, "naïve é ’ 中文 👍 it's \r\n\r\n  x"),
        (14, "\n".join(["same line of five words"] * 30)),
    ]
    columns = [c.split()[0] for c in extra.split(",") if c.strip()]
    values = ("x",) * len(columns)
    return spark.createDataFrame(
        [r + values for r in rows], "doc_id long, text string" + (", " + extra if extra else "")
    )


def empty(df):
    return df.limit(0)
