"""Identifiers that are given once and never change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chapter_id(number: Column) -> Column:
    return F.format_string("ch%02d", number)


def heading_id(chapter: Column) -> Column:
    return F.concat(chapter, F.lit("-h000"))


def paragraph_id(chapter: Column, number: Column) -> Column:
    return F.format_string("%s-p%03d", chapter, number)


def note_id(page: Column, number: Column) -> Column:
    return F.format_string("fn-p%04d-%03d", page, number)


def image_id(page: Column, number: Column) -> Column:
    return F.format_string("img-p%04d-%03d", page, number)


def figure_id(page: Column, number: Column) -> Column:
    return F.format_string("figure-p%04d-%03d", page, number)


def page_key(index: Column) -> Column:
    """index: from 0."""
    return F.format_string("p%04d", index)


def chunk_key(chapter: Column, number: Column) -> Column:
    """number: from 0, within the chapter."""
    return F.format_string("%s-%d", chapter, number)
