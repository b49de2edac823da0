"""The character ratio in SQL: common table expressions over any table of text pairs."""

from __future__ import annotations

#: ``pairs`` (aid, a, bid, b) must exist, one text per id; ``ratios`` (aid, bid, ratio) is the result. Equal characters that may begin a
#: block make runs per diagonal, equal characters around a run widen it, and ranges are cut at their longest run
#: until no run is left in them. Characters of a long b that occur more than 1 % + 1 times begin no block.
RATIO = """a_chars AS (SELECT aid, unnest(range(length(a))) AS i, unnest(list_transform(range(1, length(a) + 1), lambda k: substr(a, k, 1))) AS ch
  FROM (SELECT DISTINCT aid, a FROM pairs)),
 b_chars AS (SELECT bid, length(b) AS lb, unnest(range(length(b))) AS j, unnest(list_transform(range(1, length(b) + 1), lambda k: substr(b, k, 1))) AS ch
  FROM (SELECT DISTINCT bid, b FROM pairs)),
 begins AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY bid, ch) AS often FROM b_chars) WHERE lb < 200 OR often <= lb // 100 + 1),
 met AS (SELECT p.aid, p.bid, c.j - x.i AS d, x.i FROM pairs p JOIN a_chars x ON x.aid = p.aid JOIN begins c ON c.bid = p.bid AND c.ch = x.ch),
 runs AS (SELECT aid, bid, d, min(i) AS s, max(i) + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY aid, bid, d ORDER BY i) AS g FROM met) GROUP BY aid, bid, d, g),
 widened(aid, bid, d, s, e, x, side) AS (
  SELECT aid, bid, d, s, e, s, -1 FROM runs UNION ALL SELECT aid, bid, d, s, e, e, 1 FROM runs UNION ALL
  SELECT w.aid, w.bid, w.d, w.s, w.e, w.x + w.side, w.side FROM widened w JOIN pairs p ON p.aid = w.aid AND p.bid = w.bid
  WHERE length(p.b) >= 200 AND CASE WHEN w.side < 0 THEN w.x > 0 AND w.x + w.d > 0 AND substr(p.a, w.x, 1) = substr(p.b, w.x + w.d, 1)
   ELSE w.x < length(p.a) AND w.x + w.d < length(p.b) AND substr(p.a, w.x + 1, 1) = substr(p.b, w.x + w.d + 1, 1) END),
 wide AS (SELECT aid, bid, d, s, e, min(x) AS es, max(x) AS ee FROM widened GROUP BY aid, bid, d, s, e),
 cut(aid, bid, alo, ahi, blo, bhi, m) AS (
  SELECT aid, bid, 0::BIGINT, length(a), 0::BIGINT, length(b), 0::BIGINT FROM pairs UNION ALL
  SELECT aid, bid, CASE side WHEN 0 THEN alo ELSE be END, CASE side WHEN 0 THEN bs ELSE ahi END, CASE side WHEN 0 THEN blo ELSE be + d END,
   CASE side WHEN 0 THEN bs + d ELSE bhi END, CASE side WHEN 0 THEN be - bs ELSE 0 END
  FROM (SELECT c.*, r.d, greatest(r.es, alo, blo - r.d) AS bs, least(r.ee, ahi, bhi - r.d) AS be,
    row_number() OVER (PARTITION BY c.aid, c.bid, alo, ahi, blo, bhi
     ORDER BY least(r.e, ahi, bhi - r.d) - greatest(r.s, alo, blo - r.d) DESC, greatest(r.s, alo, blo - r.d), r.d) AS place
   FROM cut c JOIN wide r ON r.aid = c.aid AND r.bid = c.bid
   WHERE least(r.e, ahi, bhi - r.d) > greatest(r.s, alo, blo - r.d)), (SELECT unnest([0, 1]) AS side)
  WHERE place = 1),
 first_ones AS (SELECT p.aid, p.bid, p.a, p.b, least(min(ahi), min(bhi)) AS most FROM cut JOIN pairs p USING (aid, bid) WHERE alo = 0 AND blo = 0 GROUP BY ALL),
 opened AS (SELECT aid, bid, coalesce(list_position(list_transform(range(1, most + 1), lambda k: substr(a, k, 1) = substr(b, k, 1)), false) - 1, most) AS n FROM first_ones),
 ratios AS (SELECT p.aid, p.bid, 2.0::DOUBLE * (t.m + o.n) / (length(p.a) + length(p.b)) AS ratio
  FROM pairs p JOIN (SELECT aid, bid, sum(m) AS m FROM cut GROUP BY ALL) t USING (aid, bid) JOIN opened o USING (aid, bid))"""
