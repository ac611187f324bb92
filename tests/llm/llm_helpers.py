from __future__ import annotations

#: Names that the operators use inside.
CLASHES = "id node root bucket keys line lines row h at lang_pred component_id mix_place _gone_lines host path n text_crc32 a b".split()


def with_clashes(df, keep=()):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c not in df.columns and c not in keep))


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))
