"""Columns and types of every parsed table, in order."""

from __future__ import annotations

from pyspark.sql.types import StructType

CLASSES = "patnum string, ipc string, rank long, version string"
TABLES = {
    "grant_grant": "patnum string, pubdate string, appnum string, appdate string, ipc string, ipcver string, city string, state string, country string, owner string, claims long, title string, abstract string, gen long, file string",
    "grant_ipc": CLASSES,
    "grant_cite": "src string, dst string",
    "apply_apply": "appnum string, appdate string, appname string, pubnum string, pubdate string, ipc string, ipcver string, city string, state string, country string, title string, abstract string, gen long, file string",
    "apply_ipc": CLASSES,
    "assign_assign": "assignid string, bulkid string, patnum string, execdate string, recdate string, conveyance string, assignor string, assignee string, assignee_state string, assignee_country string, gen long, file string",
    "maint_maint": "patnum string, last_maint long, ever_large boolean",
    "tmapply_tmapply": "serial string, regdate string, filedate string, n_stat long, gs_codes string, statement string, us_class string, int_class string, owners string, file string",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def columns(table: str) -> list[str]:
    return schema(table).fieldNames()
