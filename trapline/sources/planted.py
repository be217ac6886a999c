"""Overlay B — driver pages with one planted HTML snippet per page class.

k = page_id % 40; the snippet for k is inserted before ``</article>``; k
without a snippet is a control page.  Page k=22 gets ``/shop/`` appended to
its URL.  A positive and its nearest negative sit side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.sources.tables import read_table

SNIPPETS = {
    0: '<label><input type="checkbox" name="n" checked>Send me the newsletter</label>',
    1: '<label><input type="checkbox" name="n">Send me the newsletter</label>',
    2: '<label><input type="checkbox" name="t" checked>Start my monthly membership</label>',
    3: '<label><input type="checkbox" name="u" checked>Add travel insurance</label>',
    4: '<label><input type="checkbox" name="r" checked>Remember me</label>',
    5: '<div class="countdown">Hurry, the deal stops at 10:00</div>',
    6: '<div class="timer">Session 30:00</div>',
    7: '<div class="cart"><span class="price">$9.99</span><span class="price">$2.99</span><span class="price">$1.50</span></div>',
    8: '<div><span class="price">$9.99</span><span class="price">$2.99</span></div>',
    9: '<form><input type="hidden" name="cart_extra" value="sku1"></form>',
    10: '<button id="d">No, I hate savings</button>',
    11: '<button id="d">No thanks</button>',
    12: '<span class="badge">Only 2 rooms left, reserve for $99</span>',
    13: '<span class="badge">Flash sale</span>',
    14: '<span class="badge">Selling fast: 40 sold, buy now</span>',
    15: '<p>Our new album is selling fast</p>',
    16: '<a class="fine-print" href="/t">Cancellation fee terms</a><div class="sponsored">Top picks today</div>',
    17: '<button class="btn-primary">Accept all</button><button class="ghost">No thanks</button>',
    18: ('<a href="https://track.example.info/x">Download now</a>'
         '<a href="https://files.affiliate.example.info/download">Get</a><p>bundled with optional offers</p>'),
    19: '<meta http-equiv="refresh" content="3;url=/x">',
    20: '<meta http-equiv="refresh" content="60;url=/x">',
    21: '<p>Your subscription billing. To cancel, call us to cancel.</p>',
    22: '<p>Add to cart. Subscribe and save 10 percent.</p>',
    23: '<p>Manage subscription and billing details here.</p>',
    24: '<div class="bar">We use cookies. <button>Accept all</button></div>',
    25: '<div class="bar">We use cookies. <button>Accept all</button><a href="/s">Cookie settings</a></div>',
    26: '<div class="bar">We use cookies. <button>Accept all</button><button>Reject all</button></div>',
    27: '<script src="https://static.hotjar.com/c.js"></script>',
    28: '<div class="accordion">Total price per month</div>',
    29: '<p>You agree to binding arbitration. An early termination fee applies. Then $20 / month.</p>',
    30: '<p>Membership page.</p><a class="footer" href="/c">Cancel</a>',
    31: '<div class="bar">This site sets cookies.</div>',
    32: ('<button style="color:red">Go</button><button style="color:red">On</button>'
         '<button style="color: red">Up</button>'),
    33: '<p>Your cart is empty</p>',
    34: '<p>We use cookies. Accept all or reject all.</p><script src="https://static.hotjar.com/c.js"></script>',
}
N_CLASSES = 40
SHOP_CLASS = 22


def snippets_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SNIPPETS.items()), "k long, snippet string")


def planted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the snippet of their class planted (page_id, url, html, k)."""
    p = read_table(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % N_CLASSES)
    # 35-row literal table: broadcast size is fixed
    j = p.join(F.broadcast(snippets_df(spark)), "k", "left")
    html = F.when(F.col("snippet").isNull(), F.col("html")).otherwise(
        F.replace(F.col("html"), F.lit("</article>"), F.concat(F.col("snippet"), F.lit("</article>"))))
    url = F.when(F.col("k") == SHOP_CLASS, F.concat(F.col("url"), F.lit("/shop/"))).otherwise(F.col("url"))
    return j.select("page_id", url.alias("url"), html.alias("html"), "k")


def planted_pages_sql() -> str:
    """DuckDB CTE ``planted`` with the same rows."""
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {q(v)})" for k, v in sorted(SNIPPETS.items()))
    return f"""snippets(k, snippet) AS (VALUES {rows}),
planted AS (
  SELECT p.page_id,
         CASE WHEN p.page_id % {N_CLASSES} = {SHOP_CLASS} THEN p.url || '/shop/' ELSE p.url END AS url,
         CASE WHEN s.snippet IS NULL THEN p.html ELSE replace(p.html, '</article>', s.snippet || '</article>') END AS html,
         p.page_id % {N_CLASSES} AS k
  FROM pages p LEFT JOIN snippets s ON s.k = p.page_id % {N_CLASSES})"""
