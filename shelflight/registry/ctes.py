"""Building blocks of the SQL twins: named sub-queries and the order they need."""

from __future__ import annotations

from shelflight.sources.testviews import FORMS, MATERIALS, PHRASES


def quoted(values) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, sql: str, *needs: str) -> None:
    _BLOCKS[name] = (needs, sql)


def with_blocks(body: str, *needs: str) -> str:
    """``body`` behind the named blocks and everything those need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in _BLOCKS[name][0]:
                visit(other)
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({_BLOCKS[n][1]})" for n in ordered) + "\n" + body


block("reviews_raw", """
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS asin,
         CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS parent_asin,
         CAST(1 + CAST(l_quantity AS INTEGER) % 5 AS DOUBLE) AS rating,
         l_returnflag AS title, l_linestatus AS text,
         CAST(l_linenumber - 2 AS BIGINT) AS helpful_vote,
         l_returnflag <> 'R' AS verified_purchase, o_orderdate AS ts
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
block("reviews_norm", """
  SELECT user_id AS amazon_user_id, asin, parent_asin, rating, title AS review_title,
         text AS review_text, helpful_vote, verified_purchase AS verified, ts FROM reviews_raw""",
      "reviews_raw")
block("reviews_clean", """
  SELECT amazon_user_id, asin, parent_asin, rating, review_title, review_text,
         greatest(coalesce(helpful_vote, 0), 0) AS helpful_vote, verified, ts
  FROM reviews_norm
  WHERE amazon_user_id IS NOT NULL AND asin IS NOT NULL AND rating BETWEEN 1 AND 5
  QUALIFY row_number() OVER (
    PARTITION BY amazon_user_id, asin
    ORDER BY ts DESC NULLS LAST, greatest(coalesce(helpful_vote, 0), 0) DESC, rating DESC,
             review_title DESC, review_text DESC, verified DESC, parent_asin DESC NULLS LAST) = 1""",
      "reviews_norm")
block("interactions", """
  SELECT amazon_user_id AS user_id, coalesce(parent_asin, asin) AS item_id, rating, ts
  FROM reviews_clean""", "reviews_clean")
block("popularity", """
  SELECT item_id, count(*) AS interaction_count, avg(rating) AS mean_rating
  FROM interactions GROUP BY item_id""", "interactions")
block("popularity_norm", """
  SELECT item_id,
         CASE WHEN max(ln(1 + interaction_count)) OVER () > min(ln(1 + interaction_count)) OVER ()
              THEN (ln(1 + interaction_count) - min(ln(1 + interaction_count)) OVER ())
                   / (max(ln(1 + interaction_count)) OVER () - min(ln(1 + interaction_count)) OVER ())
              ELSE 0.0 END AS popularity_score,
         (mean_rating - 1) / 4 AS rating_score
  FROM popularity""", "popularity")
block("split", """
  SELECT *, max(ts) OVER (PARTITION BY user_id) AS last_ts FROM interactions""", "interactions")
block("train", "SELECT user_id, item_id, rating, ts FROM split WHERE ts < last_ts", "split")
block("test", "SELECT user_id, item_id, rating, ts FROM split WHERE ts = last_ts", "split")
block("rated", """
  SELECT l_partkey, avg(1 + CAST(l_quantity AS INTEGER) % 5) AS average_rating, count(*) AS rating_number
  FROM lineitem GROUP BY l_partkey""")
block("meta", f"""
  SELECT CAST(p_partkey AS VARCHAR) AS parent_asin,
         p_name || ' ' || ({quoted(PHRASES)})[p_size] AS title,
         CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS store,
         CASE WHEN p_type = 'STANDARD' THEN 'All Beauty' ELSE p_type END AS main_category,
         average_rating, rating_number,
         CASE p_partkey % 6 WHEN 3 THEN 'img/' || p_partkey || '/hi'
                            WHEN 4 THEN 'img/' || p_partkey END AS primary_image,
         CASE p_partkey % 4
           WHEN 1 THEN MAP {{'Color': split_part(p_name, ' ', 1),
                             'Material': ({quoted(MATERIALS)})[p_partkey % {len(MATERIALS)} + 1],
                             'Item Form': ({quoted(FORMS)})[p_partkey % {len(FORMS)} + 1],
                             'Size': CAST(p_size AS VARCHAR)}}
           WHEN 2 THEN MAP {{'Brand': p_brand, 'Color': split_part(p_name, ' ', 1),
                             'Style': p_type, 'Scent': 'N/A'}}
           WHEN 3 THEN MAP {{'category': 'Tools ' || p_brand, 'Item Weight': '2 pounds'}} END AS details,
         CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price,
         CASE p_partkey % 3 WHEN 0 THEN ['All Beauty']
                            WHEN 1 THEN ['Shelf ' || p_brand, 'Other'] END AS categories,
         CASE WHEN p_partkey % 5 <> 0
              THEN ['abc', 'Made for ' || p_name, '  Easy to clean.  ', p_brand] END AS features,
         CASE WHEN p_partkey % 7 <> 0
              THEN ['Short.', 'A perfect gift for everyone',
                    'This ' || p_name || ' lasts long. Second sentence!'] END AS description
  FROM part LEFT JOIN rated ON l_partkey = p_partkey""", "rated")
block("products", """
  SELECT parent_asin, title, store, main_category, average_rating AS avg_rating, rating_number,
         'p/' || parent_asin AS primary_image, store AS brand FROM meta""", "meta")
block("items", """
  SELECT CAST(p_partkey AS VARCHAR) || variant AS asin, CAST(p_partkey AS VARCHAR) AS parent_asin, variant,
         CASE p_partkey % 10 WHEN 0 THEN 'i/' || p_partkey || variant WHEN 1 THEN '' END AS primary_image,
         CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'x ' || p_type END AS category
  FROM part CROSS JOIN (VALUES (''), ('b')) v(variant)""")
block("logs", """
  SELECT event_id, user_id, json_extract_string(props, '$.k') AS asin, event_type, ts, props AS metadata
  FROM events""")
block("vectors", """
  SELECT CAST(vec_id AS VARCHAR) AS item_id, CAST(embedding AS DOUBLE[]) AS embedding,
         CAST(label AS VARCHAR) AS category FROM embeddings""")


def _unrolled_core(k: int, rounds: int) -> str:
    """SQL blocks that peel ``rounds`` times; enough rounds reach the fixpoint."""
    previous = "interactions"
    for i in range(1, rounds + 1):
        block(f"core{k}_items{i}", f"""
          SELECT * FROM {previous} WHERE item_id IN
            (SELECT item_id FROM {previous} GROUP BY item_id HAVING count(*) >= {k})""", previous)
        block(f"core{k}_{i}", f"""
          SELECT * FROM core{k}_items{i} WHERE user_id IN
            (SELECT user_id FROM core{k}_items{i} GROUP BY user_id HAVING count(*) >= {k})""",
              f"core{k}_items{i}")
        previous = f"core{k}_{i}"
    return previous


CORE5 = _unrolled_core(5, 4)
CORE20 = _unrolled_core(20, 5)
CORE25 = _unrolled_core(25, 5)

block("carts", """
  SELECT o_orderkey AS id, o_custkey AS user_id,
         CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'checked_out' END AS status, o_orderdate AS created_at
  FROM orders""")
block("cart_items", """
  SELECT l_orderkey AS cart_id, CAST(l_partkey AS VARCHAR) AS asin, sum(CAST(l_quantity AS BIGINT)) AS quantity
  FROM lineitem GROUP BY 1, 2""")
block("cart_events", """
  SELECT event_id, user_id, json_extract_string(props, '$.k') AS asin,
         CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'set' WHEN 'signup' THEN 'remove'
                         WHEN 'error' THEN 'clear' END AS op, ts,
         CAST(1 + CAST(trunc(value) AS INTEGER) % 5 AS BIGINT) AS quantity
  FROM events WHERE event_type <> 'purchase'""")
