"""Contacts in registration responses without Python: nested entities as VARIANT, walked by a recursive query.

Each level of nesting is a step of the recursion, over all responses at once. A path of places orders entities as a walk from
the first one down does: an entity comes before those within it, and they before the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WALK = """
WITH RECURSIVE top AS (
  SELECT r.key, array(t.pos) AS path, t.value AS entity, coalesce(array_contains(try_variant_get(t.value, '$.roles', 'array<string>'), 'registrar'), false) AS registrar
  FROM (SELECT key, try_parse_json(body) AS body FROM {raw}) r, LATERAL variant_explode(try_variant_get(r.body, '$.entities', 'variant')) t
), walked (key, path, entity, registrar) AS (
  SELECT key, path, entity, registrar FROM top
  UNION ALL
  SELECT w.key, concat(w.path, array(c.pos)), c.value, w.registrar
  FROM walked w, LATERAL variant_explode(try_variant_get(w.entity, '$.entities', 'variant')) c
)
SELECT key, path, registrar AND size(path) > 1 AS within, try_variant_get(entity, '$.vcardArray[1]', 'variant') AS card
FROM walked WHERE array_contains(try_variant_get(entity, '$.roles', 'array<string>'), 'abuse')
"""


def abuse_contacts(raw: DataFrame) -> DataFrame:
    """(key, abuse_email) of responses (key, body): the e-mail of the first entity with the abuse role and an e-mail, of those
    within registrars first; null if there is none. The same as the registration operators take."""
    spark = raw.sparkSession
    keyed = raw.select("key", "body")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # rows grow with the input; depth is what ends the recursion
    cards = spark.sql(_WALK, raw=keyed)
    mails = spark.sql(
        """SELECT c.key, c.path, c.within, v.pos, try_variant_get(v.value, '$[3]', 'string') AS mail FROM {cards} c, LATERAL variant_explode(c.card) v
        WHERE try_variant_get(v.value, '$[0]', 'string') = 'email' AND try_variant_get(v.value, '$[3]', 'variant') IS NOT NULL""",
        cards=cards,
    )
    order = F.struct((~F.col("within")).alias("w"), F.col("path"), F.col("pos"))
    first = mails.groupBy("key").agg(F.min_by("mail", order).alias("abuse_email"))
    return keyed.select("key").join(first, "key", "left")
