"""User-agent parsing as plain column expressions (substring tests, one regex per family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Crawlers by the token they announce (fixed values: token -> name).
CRAWLERS = {
    "Googlebot": "Googlebot",
    "bingbot": "bingbot",
    "Slurp": "Yahoo! Slurp",
    "DuckDuckBot": "DuckDuckBot",
    "Baiduspider": "Baiduspider",
    "YandexBot": "YandexBot",
    "Applebot": "Applebot",
    "facebookexternalhit": "facebook",
    "Twitterbot": "twitter",
}
ANY_CRAWLER = "(?i)(bot|crawler|spider)([-_ ./;@()]|$)"

# Browsers, most specific first (fixed values: tokens -> name, version pattern).
BROWSERS = [
    (("Edg/", "Edge/", "EdgA/", "EdgiOS/"), "Edge", "(?:Edge|EdgA|EdgiOS|Edg)/([0-9.]+)"),
    (("OPR/", "Opera"), "Opera", "(?:OPR|Opera|Version)[/ ]([0-9.]+)"),
    (("Chrome/", "CriOS/"), "Chrome", "(?:Chrome|CriOS)/([0-9.]+)"),
    (("Firefox/", "FxiOS/"), "Firefox", "(?:Firefox|FxiOS)/([0-9.]+)"),
    (("Trident/", "MSIE "), "Internet Explorer", "(?:MSIE |rv:)([0-9.]+)"),
    (("Safari/",), "Safari", "Version/([0-9.]+)"),
]

# Systems, most specific first (fixed values: token -> name, category).
SYSTEMS = [
    ("Windows Phone", "Windows Phone OS", "smartphone"),
    ("Windows NT 10.0", "Windows 10", "pc"),
    ("Windows NT 6.3", "Windows 8.1", "pc"),
    ("Windows NT 6.2", "Windows 8", "pc"),
    ("Windows NT 6.1", "Windows 7", "pc"),
    ("Windows NT 6.0", "Windows Vista", "pc"),
    ("Windows NT 5.1", "Windows XP", "pc"),
    ("Windows", "Windows UNKNOWN Ver", "pc"),
    ("PlayStation", "PlayStation", "appliance"),
    ("Nintendo", "Nintendo", "appliance"),
    ("iPhone;", "iPhone", "smartphone"),
    ("iPad;", "iPad", "smartphone"),
    ("iPod", "iPod", "smartphone"),
    ("Macintosh", "Mac OSX", "pc"),
    ("Android", "Android", "smartphone"),
    ("BlackBerry", "BlackBerry", "smartphone"),
    ("DoCoMo", "docomo", "mobilephone"),
    ("CrOS", "ChromeOS", "pc"),
    ("Linux", "Linux", "pc"),
]

# Category -> device type (fixed values); anything else is "unknown".
DEVICES = {
    "pc": "desktop",
    "smartphone": "mobile",
    "mobilephone": "mobile",
    "crawler": "bot",
    "appliance": "other",
}


def _case(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda case, p: case.when(*p), pairs[1:], F.when(*pairs[0]))


def _has(agent: Column, *tokens: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(agent, F.lit(t)) for t in tokens])


def crawler(agent: Column) -> Column:
    """Crawler name, "" for an unnamed crawler, null for anything else."""
    named = _case([(_has(agent, token), F.lit(name)) for token, name in CRAWLERS.items()])
    suspect = _has(F.lower(agent), "bot", "crawler", "spider", "slurp", "facebookexternalhit")
    return F.when(suspect, F.coalesce(named, F.when(agent.rlike(ANY_CRAWLER), F.lit(""))))


def browser_index(agent: Column) -> Column:
    """Position in ``BROWSERS`` of the first family whose token appears, or null."""
    return _case([(_has(agent, *tokens), F.lit(i)) for i, (tokens, _, _) in enumerate(BROWSERS)])


def system_index(agent: Column) -> Column:
    """Position in ``SYSTEMS`` of the first system whose token appears, or null."""
    tests = [(token, (_has(agent, token), F.lit(i))) for i, (token, _, _) in enumerate(SYSTEMS)]
    windows = [test for token, test in tests if token.startswith("Windows")]
    # These come first and share a token, so one search tells whether any of them is there.
    return F.when(_has(agent, "Windows"), _case(windows)).otherwise(_case([t for _, t in tests[len(windows):]]))


def _listed(index: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def browser(index: Column) -> Column:
    return _listed(index, [name for _, name, _ in BROWSERS])


def browser_version(agent: Column, index: Column) -> Column:
    found = _case([(index == i, F.regexp_extract(agent, regex, 1)) for i, (_, _, regex) in enumerate(BROWSERS)])
    return F.nullif(found, F.lit(""))


def system(index: Column) -> Column:
    return _listed(index, [name for _, name, _ in SYSTEMS])


def device(index: Column) -> Column:
    """Device type by system."""
    return _listed(index, [DEVICES.get(kind, "unknown") for _, _, kind in SYSTEMS])
