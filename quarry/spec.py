"""Record specification: which fields a record has, and how each one is compared.

The jobs take a spec as a parameter, so they are not tied to one document type. ``RESUME`` is the default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: kinds of a value: text, folded (text without case), phone, grade, year, date, flag, texts (list of strings)


@dataclass(frozen=True)
class RecordSpec:
    scalars: dict[str, str]
    lists: tuple[str, ...]
    records: dict[str, dict[str, str]]
    #: record list -> (flag, date): a present-word date of a flagged item counts as null
    open_ended: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: (record list, first key, second key, date keys) for error analysis of associated items
    association: tuple[str, str, str, tuple[str, ...]] | None = None

    @property
    def fields(self) -> list[str]:
        return [*self.scalars, *self.lists, *self.records]


RESUME = RecordSpec(
    scalars={"name": "text", "email": "folded", "phone": "phone", "location": "text", "summary": "text"},
    lists=("skills",),
    records={
        "education": {"degree": "folded", "institution": "text", "field": "text", "start_year": "year", "end_year": "year", "grade": "grade"},
        "experience": {"title": "text", "company": "text", "location": "text", "start_date": "date", "end_date": "date", "current": "flag", "responsibilities": "texts"},
        "projects": {"name": "text", "technologies": "texts", "description": "text"},
        "certifications": {"name": "text", "issuer": "text", "year": "year"},
    },
    open_ended={"experience": ("current", "end_date")},
    association=("experience", "title", "company", ("start_date", "end_date")),
)

RECORD_DDL = (
    "struct<name:string,email:string,phone:string,location:string,summary:string,skills:array<string>,"
    "education:array<struct<degree:string,institution:string,field:string,start_year:int,end_year:int,grade:string>>,"
    "experience:array<struct<title:string,company:string,location:string,start_date:string,end_date:string,current:boolean,responsibilities:array<string>>>,"
    "projects:array<struct<name:string,technologies:array<string>,description:string>>,"
    "certifications:array<struct<name:string,issuer:string,year:int>>>"
)
METADATA_DDL = "struct<template_id:string,template_name:string,difficulty:string,split:string,seed:int,schema_version:string,dataset_version:string>"
EXAMPLE_DDL = f"id string, text string, target {RECORD_DDL}, metadata {METADATA_DDL}"
