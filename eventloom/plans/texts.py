"""Scalar functions over all rows of ``part``. Each row builds its arguments from its key by one of some templates, and
the SQL states the value that the function must give for it, so it shares no pattern with the code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import dates as D
from ..functions import geo as G
from ..functions import phrases as PH
from ..functions import text as X
from ..operators import projection as P
from .registry import ORACLES, QUERIES, Tables


def _spark_text(template: str | None) -> Column:
    if template is None:
        return F.lit(None).cast("string")
    parts = template.split("{k}")
    return F.concat(*(c for i, p in enumerate(parts) for c in ([F.col("k")] if i else []) + [F.lit(p)]))


def _sql_text(template: str | None) -> str:
    if template is None:
        return "NULL"
    return " || k || ".join("'" + p.replace("'", "''") + "'" for p in template.split("{k}"))


def cases(name: str, function: Callable[..., Column], rows: Sequence[tuple]) -> None:
    """Registers a query of (key, result): ``rows`` hold templates of the arguments and, last, of the result; "{k}" is the key."""
    n = len(rows)

    def build(spark, sf_dir):
        picked = F.pmod("p_partkey", F.lit(n))
        arguments = []
        for i in range(len(rows[0]) - 1):
            out = F.lit(None).cast("string")
            for j, row in reversed(list(enumerate(rows))):
                out = F.when(picked == j, _spark_text(row[i])).otherwise(out)
            arguments.append(out.alias(f"a{i}"))
        keyed = Tables(spark, sf_dir).part.withColumn("k", F.col("p_partkey").cast("string")).select("p_partkey", *arguments)
        return keyed.select(F.col("p_partkey").alias("key"), function(*(F.col(f"a{i}") for i in range(len(arguments)))).cast("string").alias("result"))

    whens = " ".join(f"WHEN {j} THEN {_sql_text(row[-1])}" for j, row in enumerate(rows))
    QUERIES[name] = build
    ORACLES[name] = f"SELECT key, CAST(CASE key % {n} {whens} END AS VARCHAR) AS result FROM (SELECT p_partkey AS key, CAST(p_partkey AS VARCHAR) AS k FROM part)"


def _joined(columns: dict[str, Column]) -> Column:
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("-")) for c in columns.values()))


def _names(c: Column) -> Column:
    return F.split(c, ",")


cases("title_sanitized", C.sanitized_title, [
    ("Gender Blender {k}", "Gender Blender {k}"), ("12:30pm", None), ("1pm", None), ("18:30", None), ("BH3: hares needed for {k}", None), ("Need a hare {k}!", None), ("Wanna Hare? Check out our available dates", None),
    ("Mosquito H3 runs on the first and third Wednesdays", None), ("Hash {k} meets every Tuesday", None), ("Trail {k} 3/15/2025", "Trail {k}"), ("Run #1/25 of {k}", "Run #1/25 of {k}"),
    ("Saturday March 28th OH3 #{k} Granny Panties", "OH3 #{k} Granny Panties"), ("SWH3 #{k}- Sunday, May 24", "SWH3 #{k}"), ("Some Hares {k} - Location TBD", "Some Hares {k}"), ("TH3 #", "TH3"),
    ("Pub {k} me@example.org crawl", "Pub {k} crawl"), ("Run {k} (See: example.org for details)", "Run {k}"), ("  ", None), (None, None), ("A   B {k}", "A B {k}"),
])
cases("hares_sanitized", C.sanitized_hares, [
    ("Alice {k} & Bob", "Alice {k} & Bob"), ("TBD", None), ("Sign up!", None), ("sign up", None), ("Hares needed for Friday {k}", None), ("We need a hare, call {k}", None), ("https://maps.example.org/{k}", None), ("X", None), ("1987", None), ("2187", "2187"),
    ("Hare is Major {k}", "Major {k}"), ("Dusty {k}, we are open to more names", "Dusty {k}"), ("Alice (415) 555-1212 & Bob {k}", "Alice & Bob {k}"), ("Zed {k} Location: the pub", "Zed {k}"), ("On On: later {k}", None), ("Hash Cash: $5", None), (None, None), ("", None),
    ("Al" + "a" * 90 + ", " + "b" * 90 + ", " + "c" * 90, "Al" + "a" * 90 + ", " + "b" * 90),
])
cases("location_sanitized", C.sanitized_location, [
    ("The Pub {k}, Fernbrook, ca", "The Pub {k}, Fernbrook, CA"), ("TBA", None), ("Venue TBD", None), ("Online event", None), ("online", None), ("Registration: example.org", None), ("https://maps.example.org/{k}", None), ("Maps, The Bar {k}", "The Bar {k}"),
    ("Meet at Bar {k}", "Bar {k}"), ("Head to Park {k}", "Park {k}"), ("41.118203, -88.402917, the corner of {k}", "the corner of {k}"), ("Lot {k}. 39.402218, -81.336145", "Lot {k}"), ("Bar {k} — check the page", "Bar {k}"), ("Inquire for location: pat@club.example", None),
    ("Bar {k}, https://x.example/1, Town", "Bar {k}, Town"), ("North Alder Creek Road & {k}, N Alder Creek Rd & {k}, Fernbrook, CA", "North Alder Creek Road & {k}, Fernbrook, CA"), ("Bar {k}, Town, bar {k}", "Bar {k}, Town"), ("Fort {k}, 41°17'03.4\"N 108°41'55.2\"W", "Fort {k}"), (None, None),
    ("Lot {k} (text for address)", "Lot {k}"),
])
cases("city_to_show", C.city_to_show, [
    ("12 Main St, Hartville, OH", "Akron {k}, OH", None), ("12 Main St, Akron {k}, OH", "Akron {k}, OH", "Akron {k}, OH"), ("5 Oak, Salem, OR 97301, USA", "Marlene {k}, OR", None), ("5 Oak, Town, 26505-7511, WV, United States", "Nowhere{k}", None), ("80331 München, Germany, x", "Pasing {k}", "Pasing {k}"), ("Pub, OH", "Akron {k}", "Akron {k}"), (None, "A{k}", "A{k}"),
])
cases("titles_hared_by", lambda t, h: _joined(C.hared_by(t, h)), [
    ("Run {k} Hared by Bob &amp; Al", None, "Run {k}|Bob & Al"), ("Run {k} hare by Zoe", None, "Run {k}|Zoe"), ("Run {k} Hared by Bob", "Al", "Run {k} Hared by Bob|Al"), ("A &lt;{k}&gt; &amp;lt;", None, "A <{k}> &lt;|-"), (None, "It&#39;s {k}", "-|It's {k}"),
])
cases("weekend_end_dates", lambda t, d, s: C.weekend_end(d, t, s.cast("date")), [
    ("Campout {k}", "Friday to Sunday", "2026-05-01", "2026-05-03"), ("Run {k}", "a weekend: Fri, Sat and Sun", "2026-05-01", "2026-05-03"), ("Run {k}", "Friday to Sunday", "2026-05-01", None), ("Retreat {k}", "only Friday", "2026-05-01", None),
    ("Weekend {k}", "Thursday and Wednesday", "2026-05-01", None), ("Camp out {k}", "fri, tues", "2026-05-01", "2026-05-05"),
])
cases("friendly_names", C.friendly_name, [
    ("BH3", "Boston {k} Hash House Harriers", "Boston {k} H3"), ("LH{k}longname", "London Hash House Harriers", "LH{k}longname"), ("GV", None, "GV"), ("SLH", "SLASH (South London Hash House Harriers)", "SLASH H3"), ("XH3", "Hash House Harriers", "XH3"), ("CH", "Cape {k} Runners", "Cape {k} Runners"), ("YH3", "York {k} Hash House Harriers and Harriettes", "York {k} H3"),
])
cases("default_titles_renamed", lambda t, c, a, s: C.current_default_title(t, c, _names(a), s), [
    ("psh3 Trail #{k}", "psh3", "PSH3,Puget", "Puget Sound H3", "Puget Sound H3 Trail #{k}"), ("Bristol HHH Trail {k}", "bh3", "Bristol,Bristol HHH", "Bristol H3", "Bristol H3 Trail {k}"), ("Gender Blender {k}", "sh3", "S", "Seattle H3", "Gender Blender {k}"), ("sh3 Trailer {k}", "sh3", "x", "Seattle H3", "Seattle H3 Trailer {k}"), ("a.c Trail {k}", "abc", "a.c", "N", "N Trail {k}"), ("abc Trail {k}", "zz", "a.c", "N", "abc Trail {k}"),
])
cases("titles_replaceable", lambda t, c, a, s: C.replaceable_title(t, c, _names(a), s), [
    (None, "sh3", "S", "Seattle H3", "true"), (" ", "sh3", "S", "Seattle H3", "true"), ("SH3 #? (TBD)", "sh3", "S", "Seattle H3", "true"), ("sh3 Trail #{k}", "sh3", "S", "Seattle H3", "true"), ("Seattle H3 Trail", "sh3", "S", "Seattle H3", "true"), ("Gender Blender {k}", "sh3", "S", "Seattle H3", "false"), ("SH3 #? (Red Dress {k})", "sh3", "S", "Seattle H3", "false"), ("SH3 #12 / NB #?", "sh3", "S", "Seattle H3", "false"),
])
cases("titles_after_update", lambda new, old, run: C.title_after_update(new, old, F.lit("sh3"), F.array(F.lit("SH3")), F.lit("Seattle H3"), run.cast("int")), [
    ("Gender Blender {k}", "old", "5", "Gender Blender {k}"), ("SH3 #?", "Gender Blender {k}", "5", "Gender Blender {k}"), (None, "sh3 Trail #{k}", "5", "Seattle H3 Trail #{k}"), (None, "SH3 #? (TBD)", "77", "Seattle H3 Trail #77"), (None, None, None, "Seattle H3 Trail"), ("Seattle H3 Trail", "Real {k}", "5", "Real {k}"),
])
cases("themes", lambda t: C.theme_of(t, F.array(F.lit("sh3"), F.lit("Seattle"))), [
    ("Gender Blender {k}", "gender blender {k}"), ("SH3 Hashmas", "hashmas"), ("SH3/NBH3 Gender Blender", "gender blender"), ("SH3 #? (TBD)", ""), ("SH3 #?", ""), ("SH3 (Catholic School Girl)", "catholic school girl"), ("2nd Annual Red Dress Run", "2nd annual red dress run"), ("Seattle and SH3 #{k} Pub Crawl", "pub crawl"), (None, ""),
])
cases("cluster_keys", X.cluster_key, [
    ("BMPH3 Belgian Nash Hash #{k}", "bmph3 belgian nash hash"), ("Trail #12: Camp Weekend 2026", "camp weekend"), ("Run #3", None), ("a b", None), ("Labor Day Weekend Camp Out Trail", "labor day weekend camp"), (None, None), ("red—dress run 5", "red dress run"),
])
cases("placeholders", lambda v: F.concat_ws(",", X.is_placeholder(v).cast("string"), F.coalesce(X.strip_placeholder(v), F.lit("-"))), [
    ("TBD", "true,-"), (" venue tbd ", "true,-"), ("N/A", "true,-"), ("??", "true,-"), ("????", "false,????"), ("hares needed {k}", "true,-"), ("needs a hare", "true,-"), ("Sign-up", "true,-"), ("vacant", "true,-"), ("na", "false,na"), ("-", "false,-"), (" Pub {k} ", "false,Pub {k}"), (None, "false,-"),
])
cases("run_numbers", X.run_number, [
    ("Run #1{k}: fun", "1{k}"), ("#30X?", None), ("no number {k}", None), ("A # 12 b", "12"), ("#0", None), ("#15)", "15"), ("＃7", "7"), ("x #9th", None), (None, None),
])
cases("description_fields", lambda t: _joined(C.description_fields(t)), [
    ("Hares: Al {k}\nTime: 7:30 pm\nCost: $7\nWhere: Pub {k}\nhttps://maps.app.goo.gl/a{k} see", "Al {k}|7:30 pm|$7|Pub {k}|https://maps.app.goo.gl/a{k}"), ("nothing {k}", "-|-|-|-|-"), ("Hare: TBD\nHash Cash: free\nLocation: TBA", "-|-|free|-|-"), (None, "-|-|-|-|-"),
])
cases("lists_normalised", X.normal_list, [
    ("b {k}, a,, b {k} ,c", "a, b {k}, c"), ("x{k}", "x{k}"), (" , ", ""), (None, None),
])
cases("doubled_texts", X.collapse_doubled, [
    ("a {k}\n\nb\n\nA {k}\n\nb", "a {k}\n\nb"), ("a {k}\n\nb", "a {k}\n\nb"), ("x\n\nx", "x"), ("x\n\ny\n\nx", "x\n\ny\n\nx"), ("one {k}", "one {k}"), (None, None),
])
cases("slugs", lambda v: F.concat_ws("|", X.slug(v), X.code(v), X.region_slug(v)), [
    ("Ben Franklin Mob (BFM) {k}", "ben-franklin-mob-bfm-{k}|ben-franklin-mob-bfm-{k}|ben-franklin-mob-bfm-{k}"), ("N(Y)CH3", "nych3|n-y-ch3|nych3"), ("San Diego, CA", "san-diego-ca|san-diego-ca|san-diego-ca"), ("St. Pete--x", "st-pete-x|st-pete-x|st-pete-x"), ("O'Fallon", "o-fallon|o-fallon|o'fallon"),
])
cases("alias_lists", lambda s, f: F.array_join(C.alias_candidates(s, f), "|"), [
    ("Moon", "Moon", "Moon"),
    ("CH3", "Cape Hash House Harriers", "CH3|Cape Hash House Harriers|CHHH|C Hash|Cape H3|Cape"),
])
cases("times_12_hour", D.format_time_12, [("00:05", "12:05 AM"), ("12:00", "12:00 PM"), ("23:59", "11:59 PM"), ("9:30", "9:30 AM"), ("24:00", None), (None, None)])
cases("times_parsed", D.parse_12_hour, [("Start 7:30 pm {k}", "19:30"), ("12:05am", "00:05"), ("1:69 PM", "14:09"), ("12:00 PM", "12:00"), ("noon {k}", None), ("11:75 pm", "00:15"), (None, None)])
cases("ordinals", lambda v: D.ordinal(v.cast("int")), [("1", "1st"), ("2", "2nd"), ("3", "3rd"), ("4", "4th"), ("11", "11th"), ("112", "112th"), ("21", "21st"), ("103", "103rd")])
cases("date_ranges", lambda a, b: D.format_date_range(a.cast("date"), b.cast("date")), [
    ("2026-03-03", None, "Mar 3"), ("2026-03-03", "2026-03-05", "Mar 3 – 5"), ("2026-03-30", "2026-04-02", "Mar 30 – Apr 2"), ("2025-12-30", "2026-01-02", "Dec 30, 2025 – Jan 2, 2026"), ("2026-03-03", "2026-03-01", "Mar 3"), ("2026-03-03", "2026-03-03", "Mar 3"),
])
cases("distances_durations", lambda m, s, k: F.concat_ws("|", D.format_distance(m.cast("double")), D.format_duration(s.cast("long")), D.format_drive(k.cast("double"))), [
    ("5000", "3725", "10", "3.1 mi|1h 2m|~10 min drive"), ("160934.4", "59", "80", "100.0 mi|0m|~1h drive"), ("0", "7200", "100", "0.0 mi|2h 0m|~1h 15m drive"), ("1609.344", "600", "1", "1.0 mi|10m|~5 min drive"),
])
cases("markdown_stripped", X.plain_text, [("**bold {k}** and *it*", "bold {k} and it"), ("[text {k}](http://x)", "text {k}"), ("# Head\n> quote\n- item", "Head\nquote\nitem"), ("a\n\n\n\nb", "a\n\nb"), ("x *** y", "x \n\n y")])
cases("url_labels", X.url_label, [
    ("https://www.facebook.com/g{k}", None, "Facebook"), ("https://docs.google.com/x", "Source", "Google Sheets"), ("https://google.com/calendar/e?{k}", None, "Google Calendar"), ("https://m.meetup.com/{k}", None, "Meetup"), ("https://www.example{k}.org/a", None, "example{k}.org"), ("not a url", None, "Source"), ("https://x.org", "Mine {k}", "Mine {k}"), ("https://notfacebook.com", None, "notfacebook.com"),
])
cases("urls_checked", lambda u: F.concat_ws("|", F.coalesce(X.safe_url(u), F.lit("-")), X.trimmed_url(u), X.domain(u)), [
    (" https://a.example/{k} ", "https://a.example/{k}| https://a.example/{k} | https://a.example/{k} "), ("javascript:alert({k})", "-|javascript:alert({k})|javascript:alert({k})"), ("HTTP://WWW.Example.org/A/{k}//", "HTTP://WWW.Example.org/A/{k}//|http://www.example.org/a/{k}|example.org"), ("ftp://x.org/{k}", "-|ftp://x.org/{k}|x.org"),
])
cases("url_spellings", lambda u: F.array_join(X.url_variants(u), " "), [
    ("http://www.a.example/{k}/", "https://a.example/{k} https://a.example/{k}/ https://www.a.example/{k} https://www.a.example/{k}/ http://a.example/{k} http://a.example/{k}/ http://www.a.example/{k} http://www.a.example/{k}/"),
])
cases("display_titles", lambda t, s, f, r: X.display_title(t, s, f, r.cast("int")), [
    ("Red Dress {k}", "BH3", "Boston Hash House Harriers", "5", "Red Dress {k}"), (None, "BH3", None, "1{k}", "BH3 — Run #1{k}"), ("(TBD)", "BH3", None, None, "BH3"), ("Run #12", "BH3", None, "12", "BH3 — Run #12"), ("Boston Hash", "BH3", "Boston Hash House Harriers", None, "BH3"), ("BH3", "BH3", None, None, "BH3"), ("bh3 trail", "BH3", None, None, "bh3 trail"),
])
cases("display_locations", X.display_location, [
    ("Pub {k}", "Akron, OH", "Pub {k}, Akron, OH"), ("Pub, Akron", "Akron, OH", "Pub, Akron"), ("1 Main, Town, OH 44632", "Akron, OH", "1 Main, Town, OH 44632"), (None, "Akron {k}", "Akron {k}"), ("https://x.org/{k}", "Akron", "Akron"), ("Pub {k}", None, "Pub {k}"), (None, None, None), ("Akronite Bar", "Akron", "Akronite Bar, Akron"),
])
cases("html_to_text", X.strip_tags, [
    ("<p>a &amp; b{k}</p><p>c</p>", "a & b{k}\nc"), ("x<br>y<script>var a={k};</script>z", "x\ny z"), ("<b>t&amp;lt;</b>", "t&lt;"), ("plain {k}", "plain {k}"), ("<!-- {k} -->q", "q"), (None, None),
])
cases("dates_parsed", D.parse_date, [
    ("2026-03-05", "2026-03-05"), ("3/5/2026", "2026-03-05"), ("March 5, 2026", "2026-03-05"), ("Thursday, March 5th, 2026", "2026-03-05"), ("Mar 5, 2026", "2026-03-05"), ("5 March 2026", "2026-03-05"), ("2026-02-30", None), ("someday {k}", None), (None, None), ("3/5/26", "2026-03-05"),
])
cases("dates_spoken", lambda t, r, day_first, forward: PH.spoken_date(t, r.cast("date"), day_first == "d", forward == "f"), [
    ("5 Jun 26", "2026-03-04", "d", "", "2026-06-05"), ("6-Jun-49", "2026-03-04", "m", "", "2049-06-06"), ("6 Jun 50", "2026-03-04", "m", "", "1950-06-06"), ("31 Jun 26", "2026-03-04", "d", "", None), ("Friday 6th of March 2026 no {k}", "2025-01-01", "d", "", "2026-03-06"), ("August 7th, 2026", "2026-03-04", "m", "", "2026-08-07"),
    ("05/06/2026", "2026-03-04", "m", "", "2026-05-06"), ("05/06/2026", "2026-03-04", "d", "", "2026-06-05"), ("25/06/2026", "2026-03-04", "m", "", "2026-06-25"), ("2026-02-15T14:00:00-06:00", "2026-03-04", "m", "", "2026-02-15"), ("11-20: Harvest run {k}", "2026-01-05", "m", "", "2025-11-20"), ("11-20: Harvest run {k}", "2026-01-05", "m", "f", "2026-11-20"),
    ("4-7-26", "2026-01-01", "m", "", "2026-04-07"), ("2 January", "2026-12-10", "d", "f", "2027-01-02"), ("2 January", "2026-12-10", "d", "", "2027-01-02"), ("2 April", "2026-06-10", "d", "", "2026-04-02"), ("see you next Saturday", "2026-05-06", "m", "", "2026-05-16"), ("this Saturday", "2026-05-06", "m", "", "2026-05-09"),
    ("last Saturday", "2026-05-09", "m", "", "2026-05-02"), ("Saturday at 7pm", "2026-05-06", "m", "", "2026-05-09"), ("Monday", "2026-05-06", "m", "", "2026-05-04"), ("Monday", "2026-05-06", "m", "f", "2026-05-11"), ("in two weeks", "2026-05-06", "m", "", "2026-05-20"), ("tomorrow", "2026-12-31", "m", "", "2027-01-01"),
    ("three days ago, at {k}", "2026-03-02", "m", "", "2026-02-27"), ("next month", "2026-01-31", "m", "", "2026-02-28"), ("someday {k}", "2026-05-06", "m", "", None), ("29 February", "2026-05-06", "d", "f", "2028-02-29"), (None, "2026-05-06", "m", "", None), ("marathon of {k} mayors", "2026-05-06", "m", "", None),
])
cases("starts_in_utc", lambda d, t, z: F.date_format(D.start_utc(d.cast("date"), t, z), "yyyy-MM-dd HH:mm"), [
    ("2026-01-15", "19:00", "America/New_York", "2026-01-16 00:00"), ("2026-07-15", "19:00", "America/New_York", "2026-07-15 23:00"), ("2026-07-15", "9:30", "Europe/Berlin", "2026-07-15 07:30"), ("2026-07-15", None, "Europe/Berlin", None), ("2026-07-15", "25:00", "UTC", None),
])
cases("local_days", lambda ts, z: F.concat_ws("|", D.local_day(ts.cast("timestamp"), z).cast("string"), D.tz_abbreviation(ts.cast("timestamp"), z)), [
    ("2026-01-01 03:00:00", "America/New_York", "2025-12-31|UTC-5"), ("2026-07-01 03:00:00", "America/New_York", "2026-06-30|UTC-4"), ("2026-01-01 20:00:00", "Asia/Kolkata", "2026-01-02|UTC+5:30"), ("2026-01-01 20:00:00", "UTC", "2026-01-01|UTC+0"),
])
cases("end_times_checked", lambda a, b: F.concat_ws("|", D.implausible_end(a, b).cast("string"), F.coalesce(D.minutes_of(a).cast("string"), F.lit("-"))), [
    ("19:00", "22:00", "false|1140"), ("19:00", "06:00", "false|1140"), ("10:00", "09:00", "true|600"), ("10:00", None, "false|600"), ("24:10", "01:00", "false|-"), ("12:00", "00:00", "false|720"), ("11:59", "00:00", "true|719"),
])
cases("weekdays_shifted", lambda d, t: _joined(D.shifted_weekday(d.cast("date"), t, 0, 6, "00:00", "14:00")), [
    ("2026-05-03", "00:00", "2026-05-02|14:00"), ("2026-05-03", "10:00", "2026-05-03|10:00"), ("2026-05-04", "00:00", "2026-05-04|00:00"), ("2026-05-03", None, "2026-05-03|-"),
])
cases("nearest_weekdays", lambda d: D.shift_to_weekday(d.cast("date"), 6), [("2026-05-03", "2026-05-02"), ("2026-05-06", "2026-05-09"), ("2026-05-05", "2026-05-02"), ("2026-05-02", "2026-05-02")])
cases("map_coordinates", lambda u: _joined(G.coords_from_map_url(u)), [
    ("https://www.google.com/maps/place/x/@40.748,-73.985,17z/data=!3d40.7103089!4d-74.0165895", "40.7103089|-74.0165895"), ("https://www.google.com/maps/@40.748,-73.985,17z", "40.748|-73.985"), ("https://maps.google.com/?q=40,-73", "40.0|-73.0"), ("https://maps.google.com/?q=Pub+{k}", "-|-"),
    ("https://maps.google.com/maps?ll=1.5,2.5&z=1", "1.5|2.5"), ("https://www.google.com/maps/search/?api=1&query=40.748%2C-73.985", "40.748|-73.985"), ("https://maps.google.com/?q=0,0", "-|-"), ("https://maps.google.com/?q=40.1,-73.1x", "-|-"), (None, "-|-"), ("https://maps.google.com/?q=95,10&ll=9.5,8.5", "9.5|8.5"),
])
cases("dms_coordinates", lambda t: _joined(G.coords_from_dms(t)), [("Fort {k}, 41°17'03.4\"N 108°41'55.2\"W", "41.284278|-108.698667"), ("34°08'52.8\"S, 112°22'05.6\"E", "-34.148|112.368222"), ("none {k}", "-|-"), ("95°00'00\"N 10°00'00\"E", "-|-")])
cases("viewports", lambda a, o: _joined(G.viewport(a.cast("double"), o.cast("double"), 0.5)), [("40", "-73", "39.5|-73.5|40.5|-72.5"), ("89.75", "179.75", "89.25|179.25|90.0|180.0")])
cases("radius_tiers", lambda k: F.concat_ws("|", G.snap_radius(k.cast("double")).cast("string"), G.distance_tier(k.cast("double"))), [("10", "10|nearby"), ("17", "10|area"), ("18", "25|area"), ("400", "250|drive"), ("26", "25|drive")])
cases("coordinates_chosen", lambda r, c, s, z, g: _joined(G.chosen_coords(*[(F.split_part(p, F.lit(" "), F.lit(1)).try_cast("double"), F.split_part(p, F.lit(" "), F.lit(2)).try_cast("double")) for p in (r, c)], s == "same", *[(F.split_part(p, F.lit(" "), F.lit(1)).try_cast("double"), F.split_part(p, F.lit(" "), F.lit(2)).try_cast("double")) for p in (z, g)], (F.lit(40.0), F.lit(-73.0)))), [
    ("1.0 2.0", "3.0 4.0", "same", "5.0 6.0", "40.1 -73.1", "1.0|2.0"), (None, "3.0 4.0", "same", "5.0 6.0", "40.1 -73.1", "3.0|4.0"), (None, "3.0 4.0", "other", "5.0 6.0", "40.1 -73.1", "5.0|6.0"), (None, None, "other", None, "40.1 -73.1", "40.1|-73.1"), (None, None, "same", None, "50.0 -73.1", "-|-"), ("1.0 ", "3.0 4.0", "same", None, None, "3.0|4.0"),
])
cases("rounding_half_up", lambda v: D.round_half_up(v.cast("double")), [("-2.5", "-2"), ("2.5", "3"), ("-2.6", "-3"), ("0.49", "0"), ("7", "7")])
cases("confidence_scores", lambda b, e, v, i: P.scored_confidence(b, e.cast("int"), v.cast("int"), i.cast("int")), [
    ("LOW", "9", "1", "1", "LOW"), ("MEDIUM", "3", "29", "10", "HIGH"), ("MEDIUM", "3", "30", "10", "MEDIUM"), ("MEDIUM", "3", "29", "91", "MEDIUM"), ("HIGH", "3", "181", "10", "MEDIUM"), ("HIGH", "0", "10", "91", "LOW"), ("MEDIUM", "0", None, None, "LOW"), ("HIGH", "0", "10", "10", "HIGH"), ("MEDIUM", "2", "1", None, "MEDIUM"),
])
cases("name_similarities", lambda a, b: F.concat_ws("|", D.round_half_up(X.name_similarity(a, b) * 1000).cast("string"), D.round_half_up(X.candidate_score(a, F.array(b, F.lit("zzzzzzzzzzzz"))) * 1000).cast("string")), [
    ("Boston", "boston ", "1000|1000"), ("kitten", "sitting", "571|571"), ("", "x", "0|0"), (None, "x", "0|0"), ("Boston H", "Boston", "750|1000"), ("abc", "abcd", "750|750"),
])
cases("activity_states", lambda d, u: D.activity_status(d.cast("date"), F.lit("2026-01-01").cast("date"), u == "up"), [
    (None, None, "unknown"), ("2025-12-01", None, "active"), ("2025-10-03", None, "possibly-inactive"), ("2025-01-01", None, "inactive"), ("2020-01-01", "up", "active"), ("2026-03-01", None, "active"),
])
cases("zoned_gaps", D.zoned_gap_minutes, [
    ("19:00", "America/New_York", "19:30", "America/New_York", "30"), ("19:00", "America/New_York", "16:10", "America/Los_Angeles", "10"), ("12:00", None, "13:00", "Europe/Berlin", "60"), ("01:00", "Europe/Berlin", "00:00", "UTC", "0"), ("x", "UTC", "00:00", "UTC", None),
])
