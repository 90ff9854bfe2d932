"""Text functions: tags of grounded stories, markdown tables of scene descriptions, labels and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of setting elements and narrative phases, in declaration order.
SETTING_ELEMENTS = ("Location", "Environment", "Lighting", "Weather", "Time Period", "Architecture", "Interior Design", "Atmosphere", "Background")
NARRATIVE_PHASES = ("Introduction", "Development", "Conflict", "Turning Point", "Conclusion")
# Column headers of the three tables of an image and of the narrative table, with their rules.
CHARACTER_HEADERS = ("Character ID", "Name", "Description", "Emotions", "Actions", "Narrative Function", "Bounding Box")
OBJECT_HEADERS = ("Object ID", "Description", "Function", "Interaction", "Narrative Function", "Bounding Box")
SETTING_HEADERS = ("Setting Element", "Description", "Mood", "Time", "Narrative Function")
PHASE_HEADERS = ("Narrative Phase", "Description", "Key Events", "Images")
CHARACTER_RULE = "|--------------|------|-------------|----------|---------|-------------------|--------------|"
OBJECT_RULE = "|-----------|-------------|----------|------------|-------------------|--------------|"
SETTING_RULE = "|-----------------|-------------|------|------|-------------------|"
PHASE_RULE = "|-----------------|-------------|-----------|--------|"
# Headings and tags of the file format, oddities included (a table's last row needs its line end).
IMAGE_HEADING = r"## Image (\d+)\s*\n"
TABLE_AFTER = r"(?d)### {name}\s*\n((?:.++\n)++)"
NARRATIVE_TABLE = r"(?d)## Narrative Structure\s*\n((?:.++(?:\n|\z))++)"
# Classes of things that fill areas.
STUFF_CLASSES = (
    "house", "light", "mirror-stuff", "net", "pillow", "platform", "playingfield", "railroad", "river", "road", "roof", "sand",
    "sea", "shelf", "snow", "stairs", "tent", "towel", "wall-brick", "wall-stone", "wall-tile", "wall-wood", "water-other",
    "window-blind", "window-other", "tree-merged", "fence-merged", "ceiling-merged", "sky-other-merged", "cabinet-merged",
    "table-merged", "floor-other-merged", "pavement-merged", "mountain-merged", "grass-merged", "dirt-merged", "paper-merged",
    "food-other-merged", "building-other-merged", "rock-merged", "wall-other-merged", "rug-merged",
)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, although it is used more than once or inside other functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Fixed value: the characters of Unicode's property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends; blanks first, which are most of it and found fast."""
    return F.btrim(F.trim(c), F.lit(WHITE))


# --- tagged stories -------------------------------------------------------------------------------------


def strip_story_tags(c: Column) -> Column:
    """Drop image, object, action and location tags; at most one blank line stays."""
    bare = F.regexp_replace(F.regexp_replace(c, r"<gdi image\d+>|</gdi>", ""), r"<gd[oal][^>]*>|</gd[oal]>", "")
    return strip(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def strip_any_tags(c: Column) -> Column:
    return strip(F.regexp_replace(c, "<[^>]+>", ""))


def reasoning_text(c: Column) -> Column:
    """The first thought between its tags, stripped; empty if there is none."""
    after = F.substr(c, F.instr(c, "<think>") + 7)
    closed = F.contains(c, F.lit("<think>")) & F.contains(after, F.lit("</think>"))
    return F.when(closed, strip(F.substring_index(after, "</think>", 1))).when(c.isNotNull(), "")


def story_text(c: Column) -> Column:
    """What follows the first closing thought tag and one more character; all of it if there are no such tags."""
    at = F.instr(c, "</think>")
    return F.when(at > 0, strip(F.substr(c, at + 9))).when(F.contains(c, F.lit("<think>")), F.lit("")).otherwise(c)


def clean_story(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(story_text(c), "<[^>]+>", ""), r"(?U)\s+", " "))


def story_images(c: Column) -> Column:
    """array<struct<image_number,text>> of the tagged images, by number and then place."""
    number = F.regexp_extract_all(c, F.lit(r"(?s)<gdi image(\d+)>(.*?)</gdi>"), F.lit(1))
    text = F.regexp_extract_all(c, F.lit(r"(?s)<gdi image(\d+)>(.*?)</gdi>"), F.lit(2))
    rows = F.zip_with(number, text, lambda n, t: F.struct(n.cast("int").alias("image_number"), t.alias("text")))
    placed = F.transform(rows, lambda r, i: F.struct(r["image_number"].alias("n"), i.alias("i"), strip(r["text"]).alias("t")))
    return F.transform(F.array_sort(placed), lambda r: F.struct(r["n"].alias("image_number"), r["t"].alias("text")))


def render_story(images: Column) -> Column:
    part = lambda i: F.concat(F.lit("<gdi image"), i["image_number"].cast("string"), F.lit(">\n"), i["text"], F.lit("\n</gdi>\n"))
    return strip(F.array_join(F.transform(images, part), "\n"))


def image_tag_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"<gdi image\d+>"))


def mentioned_ids(c: Column) -> Column:
    """Distinct ids of characters, objects and backgrounds inside any object, action or location tag."""
    inside = F.regexp_extract_all(c, F.lit(r"<gd[oal]\s+([^>]+)>"), F.lit(1))
    parts = F.flatten(F.transform(inside, lambda x: F.split(x, r"(?U)\s+")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: F.rlike(p, F.lit("^(char|obj|bg)")))))


def grounding_ids(c: Column) -> Column:
    """Distinct tokens inside object and action tags, attributes included; location tags are not looked at."""
    inside = F.regexp_extract_all(c, F.lit("(?d)<gd[oa] (.*?)>"), F.lit(1))
    parts = F.flatten(F.transform(inside, lambda x: F.split(x, r"(?U)\s+")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\b\w+\b"))


def tag_counts(c: Column) -> dict[str, Column]:
    """Character, object, action and location references, distinct entities and action tags of a story."""
    return {
        "character_refs": F.regexp_count(c, F.lit(r"(?s)<gdo char\d+[^>]*>.*?</gdo>")),
        "object_refs": F.regexp_count(c, F.lit(r"(?s)<gdo obj\d+[^>]*>.*?</gdo>")),
        "action_refs": F.regexp_count(c, F.lit(r"(?s)<gda[^>]*>.*?</gda>")),
        "setting_refs": F.regexp_count(c, F.lit(r"(?s)<gdl[^>]*>.*?</gdl>")),
        "distinct_characters": F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(r"<gdo char(\d+)"), F.lit(1)))),
        "distinct_objects": F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(r"<gdo obj(\d+)"), F.lit(1)))),
        "character_actions": F.regexp_count(c, F.lit(r"(?s)<gda char\d+[^>]*>.*?</gda>")),
    }


def pronoun_refs(c: Column, pronouns: tuple[str, ...]) -> Column:
    """Character references whose whole text is one of the pronouns; texts are lower-cased first."""
    refs = F.regexp_extract_all(c, F.lit(r"(?s)<gdo char\d+[^>]*>(.*?)</gdo>"), F.lit(1))
    return F.size(F.filter(refs, lambda r: F.lower(r).isin(*pronouns)))


def tagged_boxes(c: Column, strict: bool = True) -> Column:
    """array<struct<entity,box>> of boxes in object tags; strictly, only of tags that hold another object tag."""
    pattern = r'(?s)<gdo ((?:char|obj)\d+) bb="([^"]*)">(.*?)</gdo>'
    parts = [F.regexp_extract_all(c, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    rows = F.arrays_zip(parts[0].alias("entity"), parts[1].alias("box"), parts[2].alias("text"))
    kept = F.filter(rows, lambda r: F.contains(r["text"], F.lit("<gdo"))) if strict else rows
    return F.transform(kept, lambda r: F.struct(r["entity"].alias("entity"), r["box"].alias("box")))


# --- markdown tables ------------------------------------------------------------------------------------


def _bars(line: Column) -> Column:
    """What stands before the first bar of a line, then what stands behind each."""
    return F.split(line, r"\|", -1)


def _cells(line: Column) -> Column:
    """Texts behind each bar of a line."""
    return F.transform(F.filter(_bars(line), lambda _, i: i > 0), strip)


def _lines(c: Column) -> Column:
    return F.split(strip(c), "\n", -1)


def _table_in(lines: Column) -> Column:
    """struct<headers, rows>: the first line's cells, a line that is skipped, then rows with enough cells."""
    headers = F.filter(_cells(F.element_at(lines, 1)), lambda h: ~F.rlike(h, F.lit("^-*$")))
    data = F.filter(lines, lambda line, i: (i >= 2) & F.contains(line, F.lit("|")))
    rows = lambda h: F.filter(F.transform(data, _cells), lambda r: F.size(r) >= F.size(h))
    return bind(headers, lambda h: F.struct(h.alias("headers"), rows(h).alias("rows")))


def _table_of(c: Column) -> Column:
    return bind(_lines(c), _table_in)


def _place(headers: Column, name: Column) -> Column:
    """Where a header stands, the last one of equal ones; null if it is not there."""
    at = F.array_position(F.reverse(headers), name)
    return F.when(at > 0, (F.size(headers) - at + 1).cast("int"))


def parse_table(c: Column) -> Column:
    """array<map<string,string>> of a table; of equal headers the last one counts."""

    def mapped(t: Column) -> Column:
        kept = F.transform(F.array_distinct(t["headers"]), lambda h: F.struct(h.alias("h"), _place(t["headers"], h).alias("at")))
        return bind(kept, lambda k: F.transform(t["rows"], lambda r: F.map_from_entries(F.transform(k, lambda x: F.struct(x["h"], F.element_at(r, x["at"]))))))

    return bind(_table_of(c), mapped)


def image_numbers(c: Column) -> Column:
    """1, 2, 3 and so on, up to the first number without a header."""
    return _unbroken(F.transform(F.regexp_extract_all(c, F.lit(IMAGE_HEADING), F.lit(1)), lambda n: n.try_cast("int")))


def _unbroken(numbers: Column) -> Column:
    return bind(F.array_sort(F.filter(F.array_distinct(numbers), lambda n: n >= 1)), lambda s: F.filter(s, lambda n, i: n == i + 1))


def image_section(c: Column, n: Column) -> Column:
    """Text of image n up to the next image header; null without a header."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(IMAGE_HEADING), F.lit(1)), lambda x: x.try_cast("int"))
    at = F.array_position(numbers, n)
    return F.when(at > 0, F.try_element_at(F.split(c, IMAGE_HEADING, -1), at.cast("int") + 1))


def section_table(section: Column, name: str) -> Column:
    """The block of non-empty, ended lines under a heading; a last line without an end is not part of it."""
    return F.regexp_extract(section, TABLE_AFTER.replace("{name}", name), 1)


def narrative_table(c: Column) -> Column:
    return F.regexp_extract(c, NARRATIVE_TABLE, 1)


def typed_rows(table: Column, headers: tuple[str, ...], names: tuple[str, ...]) -> Column:
    """Rows of a table as structs; a missing header is an empty string, of equal ones the last counts.

    A table that starts with just the line that ``_table`` writes has its cells in order, so no header is looked for.
    """
    none = F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")

    def in_order(lines: Column) -> Column:
        data = F.filter(lines, lambda line, i: (i >= 2) & F.contains(line, F.lit("|")))
        whole = F.filter(F.transform(data, _bars), lambda r: F.size(r) > len(headers))
        return F.transform(whole, lambda r: F.struct(*[strip(r[k + 1]).alias(n) for k, n in enumerate(names)]))

    def read(t: Column) -> Column:
        places = F.array(*[_place(t["headers"], F.lit(h)) for h in headers])
        cell = lambda r, p, k: F.coalesce(F.when(p[k].isNotNull(), F.element_at(r, F.coalesce(p[k], F.lit(1)))), F.lit(""))
        return bind(places, lambda p: F.transform(t["rows"], lambda r: F.struct(*[cell(r, p, k).alias(n) for k, n in enumerate(names)])))

    known = lambda lines: lines[0] == _heading(headers)
    parsed = lambda t: bind(_lines(t), lambda lines: F.when(known(lines), in_order(lines)).otherwise(bind(_table_in(lines), read)))
    return bind(table, lambda t: F.when(t != "", parsed(t)).otherwise(none))


def coerce(c: Column, values: tuple[str, ...]) -> Column:
    """The value of that name, else the first value that occurs in the text, else the first of all."""

    def first(test: Callable[[str], Column]) -> Column:
        arms = F.when(test(values[0]), values[0])
        for v in values[1:]:
            arms = arms.when(test(v), v)
        return arms

    named = bind(F.replace(F.upper(c), F.lit(" "), F.lit("_")), lambda u: first(lambda v: u == v.upper().replace(" ", "_")))
    inside = bind(F.lower(c), lambda low: first(lambda v: F.contains(low, F.lit(v.lower()))))
    return F.coalesce(first(lambda v: c == v), named, inside, F.lit(values[0]))


SNAKE = {h: h.lower().replace(" ", "_") for h in (*CHARACTER_HEADERS, *OBJECT_HEADERS, *SETTING_HEADERS, *PHASE_HEADERS)}


def _parse_section(section: Column, n: Column) -> Column:
    kinds = (("characters", "Characters", CHARACTER_HEADERS), ("objects", "Objects", OBJECT_HEADERS), ("settings", "Setting", SETTING_HEADERS))
    parts = []
    for alias, heading, headers in kinds:
        rows = typed_rows(section_table(section, heading), headers, tuple(SNAKE[h] for h in headers))
        if alias == "settings":
            rows = F.transform(rows, lambda r: r.withField("setting_element", coerce(r["setting_element"], SETTING_ELEMENTS)))
        parts.append(rows.alias(alias))
    return F.struct(n.alias("image_number"), *parts)


def parse_image(c: Column, n: Column) -> Column:
    """struct<image_number, characters, objects, settings> of one image."""
    return bind(image_section(c, n), lambda section: _parse_section(section, n))


def parse_scenes(c: Column) -> Column:
    """array of ``parse_image`` for the unbroken run of image numbers; the text is cut once."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(IMAGE_HEADING), F.lit(1)), lambda x: x.try_cast("int"))

    def read(t: Column) -> Column:
        piece = lambda n: F.element_at(t["pieces"], F.array_position(t["numbers"], n).cast("int") + 1)
        return F.transform(_unbroken(t["numbers"]), lambda n: bind(piece(n), lambda section: _parse_section(section, n)))

    return bind(F.struct(numbers.alias("numbers"), F.split(c, IMAGE_HEADING, -1).alias("pieces")), read)


def parse_phases(c: Column) -> Column:
    rows = typed_rows(narrative_table(c), PHASE_HEADERS, tuple(SNAKE[h] for h in PHASE_HEADERS))
    return F.transform(rows, lambda r: r.withField("narrative_phase", coerce(r["narrative_phase"], NARRATIVE_PHASES)))


def _row(r: Column, headers: tuple[str, ...]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(r[SNAKE[h]], F.lit("")) for h in headers]), F.lit(" |"))


def _heading(headers: tuple[str, ...]) -> Column:
    return F.lit("| " + " | ".join(headers) + " |")


def _table(rows: Column, headers: tuple[str, ...], rule: str) -> Column:
    return F.concat(F.array(_heading(headers), F.lit(rule)), F.transform(rows, lambda r: _row(r, headers)))


def render_scenes(images: Column, phases: Column | None = None) -> Column:
    """The markdown that ``parse_scenes`` and ``parse_phases`` read."""

    def one(i: Column) -> Column:
        return F.concat(
            F.array(F.concat(F.lit("## Image "), i["image_number"].cast("string")), F.lit(""), F.lit("### Characters")),
            _table(i["characters"], CHARACTER_HEADERS, CHARACTER_RULE),
            F.array(F.lit(""), F.lit("### Objects")),
            _table(i["objects"], OBJECT_HEADERS, OBJECT_RULE),
            F.array(F.lit(""), F.lit("### Setting")),
            _table(i["settings"], SETTING_HEADERS, SETTING_RULE),
            F.array(F.lit(""), F.lit("")),
        )

    lines = F.flatten(F.transform(images, one))
    if phases is not None:
        lines = F.concat(lines, F.array(F.lit("## Narrative Structure"), F.lit("")), _table(phases, PHASE_HEADERS, PHASE_RULE))
    return F.array_join(lines, "\n")


def listed_images(c: Column) -> Column:
    """The first number of each comma-separated part."""
    return F.filter(F.transform(F.split(c, ","), lambda p: F.regexp_extract(p, r"(\d+)", 1).try_cast("int")), lambda n: n.isNotNull())


# --- labels and identifiers -----------------------------------------------------------------------------


def clean_label(c: Column) -> Column:
    for ending in ("-other-merged", "-merged", "-other"):
        c = F.replace(c, F.lit(ending), F.lit(""))
    return c


def normal_label(c: Column) -> Column:
    return F.translate(c, " _", "--")


def readable_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def placeholder_tag(label: Column, id_: Column, image: Column, box: tuple[Column, ...]) -> Column:
    """``[global id: x,y,w,h]`` with two decimals."""
    return F.concat(F.lit("["), global_id(label, id_, image), F.lit(": "), F.concat_ws(",", *(F.format_string("%.2f", c) for c in box)), F.lit("]"))


def global_id(label: Column, id_: Column, image: Column) -> Column:
    return F.when(image.isNotNull(), F.lower(F.concat_ws("-", image, label, id_.cast("string")))).otherwise(F.concat_ws("-", label, id_.cast("string")))


def is_stuff(label: Column) -> Column:
    """True if the label is part of the name of a stuff class."""
    return F.exists(F.array(*map(F.lit, STUFF_CLASSES)), lambda s: F.contains(s, label))


def movie_and_scene(c: Column) -> tuple[Column, Column]:
    named = lambda p, k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    scene, seq = r"(?i)^(.+?)_scene_?(\d+)", r"(?i)^(.+?)_seq_?(\d+)"
    parts = F.split(c, "_")
    second = F.try_element_at(parts, F.lit(2))
    movie = F.coalesce(named(scene, 1), named(seq, 1), F.element_at(parts, 1))
    number = F.coalesce(named(scene, 2), named(seq, 2), F.when(F.rlike(second, F.lit(r"^\d+$")), second))
    return movie, number


def landmark_name(c: Column) -> Column:
    """No name is empty; a trailing word for building goes; separators become blanks."""
    bare = strip(F.regexp_replace(c, "(?i)building$", ""))
    return F.translate(F.coalesce(bare, F.lit("")), "_-", "  ")


def landmark_name_is_specific(box_id: Column, name: Column) -> Column:
    return F.regexp_replace(box_id, "-[^-]*$", "") != F.replace(F.lower(name), F.lit(" "), F.lit("-"))


LANDMARKS = "struct<landmarks:array<struct<name:string,use_box_id:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>>>>"


def parse_landmark_reply(c: Column) -> Column:
    """The JSON object in a reply; an empty list if there is none that can be read."""
    found = F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), LANDMARKS)["landmarks"]
    return F.coalesce(found, F.array().cast("array<struct<name:string,use_box_id:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>>>"))
