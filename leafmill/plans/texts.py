"""Queries of SURVEY section 2.4: scalar text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import names, text
from leafmill.plans.registry import query
from leafmill.plans.scans import NAT
from leafmill.plans.standins import BOXES, MEMBERS, boxes, members, table

_WORDS = "[" + ", ".join(f"'{w}'" for w in text.FUNCTION_WORDS) + "]"


@query("txt01_natural_key", f"with {MEMBERS} select item, page_id, row_number() over (partition by item order by {NAT.format(p='member')}, member, page_id) as place from members")
def natural_key(spark, sf_dir):
    order = Window.partitionBy("item").orderBy(names.natural_key(F.col("member")), "member", "page_id")
    return members(spark, sf_dir).select("item", "page_id", F.row_number().over(order).cast("long").alias("place"))


_JA = "case when doc_id % 2 = 0 then text || '...．．ＡＢｚ９' else text end"


@query("txt02_canonical_ja", f"select doc_id, translate(regexp_replace({_JA}, '(?:．|\\.){{3,}}', '…', 'g'), '{''.join(chr(c) for a, b in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(a, b))}', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') as text from documents")
def canonical_ja(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.canonical_ja(F.expr(_JA)).alias("text"))


@query("txt03_canonical_zh", "select doc_id, case when doc_id % 2 = 0 then translate(text, '?!,:;', '？！，：；') else text end as text from documents")
def canonical_zh(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, text.canonical_zh(F.col("text"))).otherwise(F.col("text")).alias("text"))


@query("txt04_join_lines", "select doc_id, case when doc_id % 2 = 0 then translate(array_to_string(string_split(text, chr(10)), ''), '?!,:;', '？！，：；') else array_to_string(string_split(text, chr(10)), ' ') end as text from documents")
def join_lines(spark, sf_dir):
    lang = F.when(F.col("doc_id") % 2 == 0, "zh").otherwise("ko")
    return table(spark, sf_dir, "documents").select("doc_id", text.join_lines(F.split("text", "\n"), lang).alias("text"))


@query("txt05_cer", """select doc_id, item_id, case when want = '' then case when got = '' then 0.0 else 1.0 end else cast(levenshtein(got, want) as double) / length(want) end as cer
  from (select doc_id, regexp_replace(text, '[^ -~]', '', 'g') as got from documents) d join (select item_id, case when item_id % 9 = 0 then '' else regexp_replace(text, '[^ -~]', '', 'g') end as want from benchmark) b on doc_id = item_id""")
def cer(spark, sf_dir):
    ascii_only = lambda c: F.regexp_replace(c, "[^ -~]", "")
    got = table(spark, sf_dir, "documents").select("doc_id", ascii_only("text").alias("got"))
    want = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 9 == 0, "").otherwise(ascii_only("text")).alias("want"))
    return got.join(want, got["doc_id"] == want["item_id"]).select("doc_id", "item_id", text.cer(F.col("got"), F.col("want")).alias("cer"))


@query("txt06_function_words", f"select doc_id, list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: list_contains({_WORDS}, lower(w)) and not (doc_id % 2 = 0 and lower(w) in ('as', 'the'))) as words from documents")
def function_words(spark, sf_dir):
    allow = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("as"), F.lit("the"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", text.english_function_words(F.col("text"), allow).alias("words"))


@query("txt07_ngrams", """with w as (select list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from conversations), g as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || chr(31) || w[i + 1])) as gram from w where len(w) >= 2) select gram, count(*) as n from g group by gram""")
def ngrams(spark, sf_dir):
    """Multiset of word pairs over all turns: built per row, counted map-side first."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select(F.explode(text.ngrams(words, 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_MARKS = text.ASCII_PUNCTUATION.replace("'", "''")
CHRF_WORDS = f"""flatten(list_transform(list_filter(string_split_regex({{t}}, '\\s+'), lambda w: w <> ''), lambda w: case when length(w) > 1 and contains('{_MARKS.replace('{', '{{').replace('}', '}}')}', w[-1]) then [w[:-2], w[-1]] when length(w) > 1 and contains('{_MARKS.replace('{', '{{').replace('}', '}}')}', w[1]) then [w[1], w[2:]] else [w] end))"""


@query("txt08_chrf_tokens", f"select conv_id, turn, {CHRF_WORDS.format(t='text')} as words from conversations")
def chrf_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.chrf_words(F.col("text")).alias("words"))


@query("txt09_prompt")
def prompt(spark, sf_dir):
    """Prompt of each page: instruction, glossary pairs, then its regions as JSON, boxes only where an image is sent."""
    region = F.struct("id", F.col("text"), F.when(F.col("boxed"), F.array("id", "id")).alias("box"))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("page"), F.col("doc_id").alias("id"), F.col("text"), (F.col("lang") == "en").alias("boxed"))
    regions = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("id", region.alias("r")))), lambda x: x["r"]))
    glossary = F.lit("senpai -> kakak kelas\nbaka -> bodoh")
    return rows.groupBy("page").agg(regions.alias("regions")).select("page", F.concat_ws("\n\n", F.lit("Translate every region."), glossary, "regions").alias("prompt"))




@query("txt10_reply_parse", f"""select conv_id, turn, r.id as id, r.text as text from (select conv_id, turn, unnest([{{'id': 1, 'text': role}}, {{'id': 2, 'text': null}}, {{'id': 3, 'text': null}}, {{'id': 4, 'text': ''}}, {{'id': 5, 'text': ''}}]) as r from conversations where turn % 3 <> 1)""")
def reply_parse(spark, sf_dir):
    """Replies to rows: between the first and the last brace, null stays null, other types are empty, the last of equal ids wins, no object gives no row."""
    raw = F.when(F.col("turn") % 3 == 1, "no object").otherwise(F.concat(F.lit('sure: {"translations":[{"id":1,"text":"a"},{"id":2,"text":null},{"id":3,"text":" \'null\' "},{"id":4,"text":7},{"id":1,"text":"'), "role", F.lit('"},{"id":5}]} bye')))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.reply_map(raw)).alias("id", "text"))


_SSE = """'data: {"choices":[{"index":0,"delta":{"content":"' || role || '"}},{"index":1,"delta":{"content":"no"}}]}' || chr(10) || ': alive' || chr(10) || 'data: {"choices":[{"delta":{"content":" t' || turn || '"}}]}' || chr(10) || 'data: {"choices":[{"index":0,"message":{"content":"!"}}]}' || chr(10) || 'data: [DONE]' || chr(10) || 'data: {"choices":[{"delta":{"content":"late"}}]}'"""


@query("txt11_event_stream_reply", "select conv_id, turn, role || ' t' || turn || '!' as content from conversations")
def event_stream_reply(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.stream_content(F.expr(_SSE)).alias("content"))


_SLUG = "regexp_replace({t}, '[^A-Za-z0-9._-]+', '-', 'g')"


@query("txt12_slugs", f"""with s as (select p_partkey, p_name || case when p_partkey % 2 = 0 then '/v1 beta' else '' end as m from part), t as (select *, substr(trim({_SLUG.format(t='m')}, '-'), 1, 40) as safe, trim({_SLUG.format(t='m')}, '-.') as job from s),
  u as (select *, case when safe = '' then 'none' else safe end || '-' || substr(sha256(m), 1, 8) as slug from t)
  select p_partkey, slug, 'tr_pt-BR_' || slug || '.json' as file, case when job = m then m else case when substr(job, 1, 40) = '' then 'job' else substr(job, 1, 40) end || '-' || substr(sha256(m), 1, 8) end as job_key from u""")
def slugs(spark, sf_dir):
    m = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "/v1 beta").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.model_slug(m).alias("slug"), text.translation_name(F.lit("pt-BR"), m).alias("file"), text.job_key(m).alias("job_key"))


@query("txt13_data_url", "select page_id, 'data:' || case when page_id % 2 = 0 then 'image/jpeg' else 'image/png' end || ';base64,' || to_base64(case when page_id % 2 = 0 then from_hex('FFD8FF') else from_hex('89504E') end || encode(url)) as data_url from pages")
def data_url(spark, sf_dir):
    body = F.concat(F.when(F.col("page_id") % 2 == 0, F.unhex(F.lit("FFD8FF"))).otherwise(F.unhex(F.lit("89504E"))), F.encode("url", "utf-8"))
    mime = F.when(F.hex(F.substring(body, 1, 3)) == "FFD8FF", "image/jpeg").otherwise("image/png")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(body), "\r\n", "")).alias("data_url"))


_LONG = r"case page_id % 3 when 0 then '\\?\UNC\' || url when 1 then '\\?\C:\' || url else url end"


@query("txt14_display_path", rf"select page_id, case page_id % 3 when 0 then '\\' || url when 1 then 'C:\' || url else url end as path from pages")
def display_path(spark, sf_dir):
    p = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\\\\?\\UNC\\"), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("\\\\?\\C:\\"), "url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", names.display_path(p).alias("path"))


@query("txt15_page_relative_box", f"with {BOXES} select page, id, [{', '.join(f'cast(round_even({c} * 1000.0::double / 560, 0) as int)' for c in ('x0', 'y0', 'x1', 'y1'))}] as box from boxes")
def page_relative_box(spark, sf_dir):
    """Thousandths of the page, rounded half to even."""
    return boxes(spark, sf_dir).select("page", "id", F.array(*[F.bround(F.col(c) * 1000.0 / 560, 0).cast("int") for c in ("x0", "y0", "x1", "y1")]).alias("box"))


@query("txt16_reasons", f"select event_id, 'provider answered ' || event_type || ': ' || substr(props, 1, 400) as reason, case when event_id % 3 = 0 then 'timed out after ' || (event_id % 7) || ' s' end as late from events")
def reasons(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.format_string("provider answered %s: %s", "event_type", F.substring("props", 1, 400)).alias("reason"), F.when(F.col("event_id") % 3 == 0, F.format_string("timed out after %d s", F.col("event_id") % 7)).alias("late"))


@query("txt17_probe_token")
def probe_token(spark, sf_dir):
    """Four characters of an alphabet without look-alikes, from a hash of the event so that a retry asks the same."""
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    part = lambda k: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(F.lit(k), "event_id"), F.lit(32)) + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "events").select("event_id", F.concat(*[part(k) for k in range(4)]).alias("token"))


@query("txt18_truncate", "select doc_id, substr(text, 1, 200) as a, substr(text, 1, 300) as b, substr(text, 1, 400) as c from documents")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.substring("text", 1, n).alias(c) for c, n in (("a", 200), ("b", 300), ("c", 400))])
