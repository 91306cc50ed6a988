"""Declared schemas of the catalogue's tables and of an edition, the record that every source yields."""

from __future__ import annotations

#: Spark DDL of each table.
TABLES: dict[str, str] = {
    "libraries": ("id bigint, name string, type string, path string, sync_interval_seconds bigint, status string, purge_at bigint, last_sync_at bigint, last_sync_error string, checkpoint string, created_at bigint"),
    "settings": ("key string, value string"),
    "series": ("id bigint, name string, name_fold string"),
    "authors": ("id bigint, name string, name_fold string"),
    "genres": ("id bigint, name string, name_fold string"),
    "books": (
        "id bigint, library_id bigint, library_key string, title string, series_id bigint, series_number double, language string, annotation string, metadata_checked int, enrichment_checked int,"
        " publisher string, publisher_fold string, year int, rating int, content_hash string, metadata_format string, added_at bigint, imported_at bigint, manually_matched int, cover_prio int, cover_state int"
    ),
    "book_files": ("id bigint, book_id bigint, file_format string, file_size bigint, source_path string, pages int, mtime bigint"),
    "book_identifiers": ("book_id bigint, type string, value string"),
    "book_authors": ("book_id bigint, author_id bigint"),
    "book_genres": ("book_id bigint, genre_id bigint"),
}

#: What a parsed book file says.
METADATA = (
    "title string, authors array<string>, genres array<string>, annotation string, series string, series_number double, language string, publisher string, year int, pages int, identifiers array<struct<type:string,value:string>>, cover binary"
)

#: One file of one book as a source found it; ``arrival`` orders the editions of a run.
EDITION = (
    "library_id bigint, library_key string, derive_identity boolean, title string, authors array<string>, genres array<string>, annotation string, series string, series_number double, language string, publisher string,"
    " year int, pages int, rating int, added_at bigint, identifiers array<struct<type:string,value:string>>, source_path string, file_format string, file_size bigint, mtime bigint, cover binary, arrival bigint"
)

#: A language that isn't known.
UNDEFINED_LANGUAGE = "und"
#: The cover priority that a manual choice has; no file's format reaches it.
MANUAL_COVER = 1000
