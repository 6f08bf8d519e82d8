"""Grants (three formats), applications (two), transfers and trademarks.

Each XML format is a table of paths; lists (classes, citations) have readers of their own.
Numbers and classes are put in form by native columns afterwards.
"""

from __future__ import annotations

from fnmatch import fnmatch
from functools import reduce
from xml.etree.ElementTree import Element

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpanel.functions.ids import pad_class, prune_number, zero_fill
from orgpanel.operators.transfers import real_transfers
from orgpanel.schemas import columns
from orgpanel.sources.records import all_text, good, parse_records, text_at, text_chunks, xml_record

PATENT = "patnum string, pubnum string, pubdate string, appnum string, appdate string, appname string, ipcver string, city string, state string, country string, owner string, claims string, title string, abstract string, gen long, ipcs array<string>, cites array<string>"

GRANT2 = {
    "patnum": "SDOBI/B100/B110/DNUM/PDAT", "pubdate": "SDOBI/B100/B140/DATE/PDAT", "appnum": "SDOBI/B200/B210/DNUM/PDAT", "appdate": "SDOBI/B200/B220/DATE/PDAT",
    "ipcver": "SDOBI/B500/B510/B516/PDAT", "title": "SDOBI/B500/B540/STEXT/PDAT", "claims": "SDOBI/B500/B570/B577/PDAT", "owner": "SDOBI/B700/B730/B731/PARTY-US/NAM/ONM/STEXT/PDAT",
    "city": "SDOBI/B700/B730/B731/PARTY-US/ADR/CITY/PDAT", "state": "SDOBI/B700/B730/B731/PARTY-US/ADR/STATE/PDAT", "country": "SDOBI/B700/B730/B731/PARTY-US/ADR/CTRY/PDAT",
}
BIB = "us-bibliographic-data-grant"
OWNER = f"{BIB}/assignees/assignee/addressbook"
GRANT3 = {
    "patnum": f"{BIB}/publication-reference/document-id/doc-number", "pubdate": f"{BIB}/publication-reference/document-id/date", "appnum": f"{BIB}/application-reference/document-id/doc-number",
    "appdate": f"{BIB}/application-reference/document-id/date", "title": f"{BIB}/invention-title", "claims": f"{BIB}/number-of-claims",
    "owner": f"{OWNER}/orgname", "city": f"{OWNER}/address/city", "state": f"{OWNER}/address/state", "country": f"{OWNER}/address/country",
}
SUB = "subdoc-bibliographic-information"
APPLY2 = {
    "pubnum": f"{SUB}/document-id/doc-number", "pubdate": f"{SUB}/document-id/document-date", "appnum": f"{SUB}/domestic-filing-data/application-number/doc-number",
    "appdate": f"{SUB}/domestic-filing-data/filing-date", "title": f"{SUB}/technical-information/title-of-invention", "appname": f"{SUB}/assignee/organization-name",
}
APP = "us-bibliographic-data-application"
APPLY3 = {
    "pubnum": f"{APP}/publication-reference/document-id/doc-number", "pubdate": f"{APP}/publication-reference/document-id/date", "appnum": f"{APP}/application-reference/document-id/doc-number",
    "appdate": f"{APP}/application-reference/document-id/date", "appname": f"{APP}/assignees/assignee/addressbook/orgname", "title": f"{APP}/invention-title",
}


def _first(node: Element, *paths: str) -> Element | None:
    return next((found for p in paths if (found := node.find(p)) is not None), None)


def _listed(node: Element | None, head: str, rest: str, inner: str, raw: bool) -> list[str]:
    """The main class and those that follow; ``raw`` leaves the latter as they are written."""
    if node is None:
        return []
    more = [(x.text or "") if raw else text_at(x, inner) for x in node.findall(rest)]
    return [text_at(node, head), *more]


def _ipcr(node: Element | None) -> list[str]:
    if node is None:
        return []
    made = []
    for x in node.findall("classification-ipcr"):
        made.append(text_at(x, "section") + text_at(x, "class") + text_at(x, "subclass") + text_at(x, "main-group").zfill(3) + "/" + text_at(x, "subgroup"))
    return made


def _place(node: Element | None, country: str) -> dict:
    return {"city": text_at(node, "city"), "state": text_at(node, "state"), "country": text_at(node, country)} if node is not None else {}


def _abstract(root: Element, path: str) -> dict:
    node = root.find(path)
    return {"abstract": all_text(node, " ")} if node is not None else {}


def _classes3(bib: Element | None, trim: bool) -> dict:
    """Classes of the third format, by edition or else by ipcr."""
    if bib is None:
        return {"ipcs": []}
    old, new = bib.find("classification-ipc"), bib.find("classifications-ipcr")
    if old is not None:
        version = text_at(old, "edition")
        return {"ipcver": version.lstrip("0") if trim else version, "ipcs": _listed(old, "main-classification", "further-classification", "", True), "padded": not trim}
    return {"ipcver": text_at(new, "classification-ipcr/ipc-version-indicator/date"), "ipcs": _ipcr(new)}


def grant_gen2(root: Element) -> dict:
    paragraphs = root.findall("SDOAB/BTEXT/PARA")
    out = {k: text_at(root, p) for k, p in GRANT2.items()}
    out["ipcs"] = _listed(root.find("SDOBI/B500/B510"), "B511/PDAT", "B512", "PDAT", False)
    out["cites"] = [text_at(x, "PCIT/DOC/DNUM/PDAT") for x in root.findall("SDOBI/B500/B560/B561")]
    return out | {"abstract": "\n".join(map(all_text, paragraphs)), "gen": 2}


def grant_gen3(root: Element) -> dict:
    bib = root.find(BIB)
    out = {k: text_at(root, p) for k, p in GRANT3.items()} | _classes3(bib, False) | _abstract(root, "abstract")
    old = bib is not None and bib.find("references-cited") is not None
    path = "references-cited/citation" if old else "us-references-cited/us-citation"
    cited = bib.findall(path + "/patcit/document-id") if bib is not None else []
    out["cites"] = [text_at(x, "doc-number") for x in cited if text_at(x, "country") == "us" and text_at(x, "kind") != "00"]
    return out | {"gen": 3}


def apply_gen2(root: Element) -> dict:
    classes = root.find(f"{SUB}/technical-information/classification-ipc")
    home = f"{SUB}/inventors/first-named-inventor/residence"
    out = {k: text_at(root, p) for k, p in APPLY2.items()} | _place(_first(root, f"{home}/residence-us", f"{home}/residence-non-us"), "country-code")
    out["ipcver"] = text_at(classes, "classification-ipc-edition").lstrip("0")
    out["ipcs"] = _listed(classes, "classification-ipc-primary/ipc", "classification-ipc-secondary", "ipc", False)
    return out | _abstract(root, "subdoc-abstract") | {"gen": 2}


def apply_gen3(root: Element) -> dict:
    home = "applicants/{0}applicant/addressbook/address"
    where = _first(root, f"{APP}/parties/{home.format('')}", f"{APP}/us-parties/us-{home.format('us-')}")
    out = {k: text_at(root, p) for k, p in APPLY3.items()} | _classes3(root.find(APP), True)
    return out | _place(where, "country") | _abstract(root, "abstract") | {"gen": 3}


#: section -> field of a tag in it; tags that repeat within a record take the last
TAGGED = {
    "PATN": {"WKU": "patnum", "ISD": "pubdate", "APD": "appdate", "TTL": "title", "NCL": "claims", "SRC": "series", "APN": "serial"},
    "CLAS": {"EDF": "ipcver"},
    "ASSG": {"NAM": "owner", "CTY": "city"},
}
SECTIONS = {"PATN", "INVT", "ASSG", "PRIR", "CLAS", "UREF", "FREF", "OREF", "LREP", "PCTA", "ABST"}


def tagged_lines(text: str) -> list[tuple[str, str]]:
    """(tag, value) of a record; lines without a tag go on with the value before, with nothing between."""
    out: list[tuple[str, str]] = []
    for line in text.split("\n"):
        tag, value = line[:4].rstrip(), line[5:].rstrip().lower()
        if tag:
            out.append((tag, value))
        elif out:
            out[-1] = (out[-1][0], out[-1][1] + value)
    return out


def grant_gen1(chunk: bytes, file: str) -> dict | None:
    out, section, abstract = {"gen": 1, "ipcs": [], "cites": []}, "PATN", []
    for tag, value in tagged_lines(chunk.decode("latin-1")):
        if tag in SECTIONS:
            section = tag
        elif tag in ("PAL", "PAR", "PAC", "PA0", "PA1") and section == "ABST":
            abstract.append(value)
        elif (section, tag) == ("CLAS", "ICL"):
            out["ipcs"].append(value)
        elif (section, tag) == ("UREF", "PNO"):
            out["cites"].append(value)
        elif (section, tag) == ("ASSG", "STA"):
            out |= {"state": value, "country": "us"}
        elif (section, tag) == ("ASSG", "CNT"):
            out["country"] = value[:2]
        elif field := TAGGED.get(section, {}).get(tag):
            out[field] = value
    if "patnum" not in out:
        return None
    series = out.get("series")
    series = "29" if series == "d" else series.zfill(2) if series is not None else ""
    return out | {"appnum": series + out.get("serial", "")[:6], "abstract": "\n".join(abstract)}


def xml_builder(tag: str, read):
    def build(chunk: bytes, file: str) -> dict | None:
        root = xml_record(chunk, tag)
        return None if root is None else read(root)

    return build


#: format -> (file names, separator, builder, digits of a number, classes need padding)
GRANTS = {
    1: ("*.dat", "\nPATN", grant_gen1, 7, True),
    2: ("pgb*.xml", "</PATDOC>", xml_builder("PATDOC", grant_gen2), 7, True),
    3: ("ipgb*.xml", "</us-patent-grant>", xml_builder("us-patent-grant", grant_gen3), 8, True),
}
APPLIES = {
    2: ("pab*.xml", "</patent-application-publication>", xml_builder("patent-application-publication", apply_gen2)),
    3: ("ipab*.xml", "</us-patent-application>", xml_builder("us-patent-application", apply_gen3)),
}


def _of_format(paths: str | list[str], glob: str) -> str | list[str]:
    """Of a list of files those of one format; a folder is left to the reader's own filter."""
    return paths if isinstance(paths, str) else [p for p in paths if fnmatch(p.rsplit("/", 1)[-1], glob)]


def _empty(spark: SparkSession, fields: str) -> DataFrame:
    return spark.createDataFrame([], f"{fields}, file string, pos struct<block:bigint,n:bigint>, error string")


def grant_records(spark: SparkSession, path: str | list[str], formats: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """All grants of a folder, or of given files, as records with arrays of classes and citations, and an error column."""
    parts = []
    for gen in formats:
        glob, separator, build, digits, _ = GRANTS[gen]
        if not (paths := _of_format(path, glob)):
            continue
        made = parse_records(text_chunks(spark, paths, separator, glob), build, PATENT)
        made = made.withColumn("patnum", prune_number(F.col("patnum"), digits)).withColumn("cites", F.transform("cites", lambda c: prune_number(c, digits)))
        # ipcr classes have their slash already
        made = made.withColumn("ipcs", F.transform("ipcs", lambda c: F.when(c.contains("/"), c).otherwise(pad_class(c))))
        parts.append(made)
    return reduce(DataFrame.unionByName, parts) if parts else _empty(spark, PATENT)


def apply_records(spark: SparkSession, path: str | list[str], formats: tuple[int, ...] = (2, 3)) -> DataFrame:
    parts = [parse_records(text_chunks(spark, paths, APPLIES[g][1], APPLIES[g][0]), APPLIES[g][2], PATENT) for g in formats if (paths := _of_format(path, APPLIES[g][0]))]
    return reduce(DataFrame.unionByName, parts) if parts else _empty(spark, PATENT)


def class_rows(records: DataFrame, key: str) -> DataFrame:
    """(patnum, ipc, rank, version): every class with its place from 0."""
    rows = records.select(F.col(key).alias("patnum"), F.posexplode("ipcs").alias("rank", "ipc"), F.col("ipcver").alias("version"))
    return rows.select("patnum", F.nullif("ipc", F.lit("")).alias("ipc"), F.col("rank").cast("long").alias("rank"), "version")


def _main(records: DataFrame, table: str) -> DataFrame:
    main = records.withColumn("ipc", F.nullif(F.get("ipcs", F.lit(0)), F.lit("")))
    if "claims" in columns(table):
        main = main.withColumn("claims", F.col("claims").try_cast("long"))
    return main.select(*columns(table))


def grant_tables(records: DataFrame) -> dict[str, DataFrame]:
    fine = good(records)
    cites = fine.select(F.col("patnum").alias("src"), F.explode("cites").alias("dst")).withColumn("dst", F.nullif("dst", F.lit("")))
    return {"grant_grant": _main(fine, "grant_grant"), "grant_ipc": class_rows(fine, "patnum"), "grant_cite": cites}


def apply_tables(records: DataFrame) -> dict[str, DataFrame]:
    fine = good(records)
    return {"apply_apply": _main(fine, "apply_apply"), "apply_ipc": class_rows(fine, "appnum")}


TRANSFER = "reel string, frame string, conveyance string, assignor string, assignee string, execdate string, recdate string, assignee_country string, assignee_state string, patnums array<string>"


def transfer_record(root: Element) -> dict:
    """First assignor and first assignee; patents whose kind starts with b."""
    giver, taker = root.find("patent-assignors/*"), root.find("patent-assignees/*")
    documents = root.findall("patent-properties/patent-property/document-id")
    return {
        "reel": text_at(root, "assignment-record/reel-no"), "frame": text_at(root, "assignment-record/frame-no"), "conveyance": text_at(root, "assignment-record/conveyance-text"),
        "recdate": text_at(root, "assignment-record/recorded-date/date"), "assignor": text_at(giver, "name"), "execdate": text_at(giver, "execution-date/date"),
        "assignee": text_at(taker, "name"), "assignee_state": text_at(taker, "state"), "assignee_country": text_at(taker, "country-name", "united states"),
        "patnums": [text_at(d, "doc-number") for d in documents if text_at(d, "kind").startswith("b")],
    }


def transfer_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_records(text_chunks(spark, path, "</patent-assignment>", "*.xml"), xml_builder("patent-assignment", transfer_record), TRANSFER)


def transfer_tables(records: DataFrame) -> dict[str, DataFrame]:
    """One row for each patent of each transfer between organisations."""
    fine = good(records).withColumn("bulkid", F.concat(F.coalesce("reel", F.lit("")), zero_fill(F.coalesce("frame", F.lit("")), 3)))
    rows = real_transfers(fine).select("*", F.posexplode("patnums").alias("i", "number"))
    rows = rows.withColumn("assignid", F.concat("bulkid", F.lit("_"), F.col("i").cast("string"))).withColumn("patnum", F.nullif(prune_number(F.col("number"), 8), F.lit(""))).withColumn("gen", F.lit(3).cast("long"))
    return {"assign_assign": rows.select(*columns("assign_assign"), "pos")}


MARK = "serial string, regdate string, filedate string, codes array<string>, texts array<string>, us array<string>, int array<string>, names array<string>"


def mark_record(root: Element) -> dict:
    stated = [(text_at(s, "type-code"), text_at(s, "text")) for s in root.findall("case-file-statements/case-file-statement")]
    stated = [x for x in stated if x[0].startswith("gs")]
    groups = root.findall("classifications/classification")
    return {
        "serial": text_at(root, "serial-number"), "regdate": text_at(root, "case-file-header/registration-date"), "filedate": text_at(root, "case-file-header/filing-date"),
        "codes": [c for c, _ in stated], "texts": [t for _, t in stated], "us": [x.text for g in groups for x in g.findall("us-code")], "int": [x.text for g in groups for x in g.findall("international-code")],
        "names": [text_at(o, "party-name") for o in root.findall("case-file-owners/case-file-owner")],
    }


def mark_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_records(text_chunks(spark, path, "</case-file>", "apc*.xml"), xml_builder("case-file", mark_record), MARK)


def mark_tables(records: DataFrame) -> dict[str, DataFrame]:
    fine = good(records)
    joined = {"gs_codes": "codes", "statement": "texts", "us_class": "us", "int_class": "int"}
    out = fine.select("serial", "regdate", "filedate", F.size("codes").cast("long").alias("n_stat"), *[F.nullif(F.array_join(c, "; "), F.lit("")).alias(n) for n, c in joined.items()], F.nullif(F.array_join(F.array_distinct("names"), "; "), F.lit("")).alias("owners"), "file")
    return {"tmapply_tmapply": out.select(*columns("tmapply_tmapply"))}
