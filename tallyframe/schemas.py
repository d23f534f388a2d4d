"""Declared schemas of the tables that decks are read into. All are keyed by deck_id."""

from __future__ import annotations

DECK = "deck_id string"
TABLES = {
    "decks": f"{DECK}, width_pt double, height_pt double, slide_count int, major_font string, minor_font string, error string",
    "slides": f"{DECK}, slide_index int, layout_name string, layout_type string, notes string, is_hidden boolean",
    "shapes": f"{DECK}, slide_index int, uid int, shape_id int, parent_uid int, is_leaf boolean, name string, kind string, left_pt double, top_pt double, width_pt double, height_pt double, rotation double, z_order int, "
    "placeholder_type string, placeholder_idx int, geometry_from string, fill_hex string, line_hex string, image_sha1 string, image_width int, image_height int, text string, painted boolean, inset_left_pt double, inset_top_pt double, inset_right_pt double, inset_bottom_pt double, anchor string, wraps boolean, text_columns int, column_gap_pt double, autofit string, font_scale double",
    "paragraphs": f"{DECK}, slide_index int, uid int, row int, col int, para int, level int, bulleted boolean, margin_left_pt double, text string, alignment string, margin_right_pt double, indent_pt double, spacing_share double, spacing_pt double, space_pt double, space_share double",
    "runs": f"{DECK}, slide_index int, uid int, row int, col int, para int, run int, text string, font string, font_from string, size_pt double, size_from string, color_hex string, color_from string, bold boolean, hyperlink string",
    "table_cells": f"{DECK}, slide_index int, uid int, row int, col int, text string, is_merge_continuation boolean",
    "charts": f"{DECK}, slide_index int, uid int, chart_type string, title string, axis_titles array<string>, has_legend boolean, shows_labels boolean, label_formats array<string>, axis_min double, axis_max double",
    "chart_points": f"{DECK}, slide_index int, uid int, series int, series_name string, point int, category string, value double, workbook_ref string, workbook_value double, workbook_note string, fill_hex string",
    "pkg_props": f"{DECK}, part string, name string, value string",
    "pkg_rels": f"{DECK}, source string, rel_id string, type string, target string, mode string, resolved string, exists boolean",
    "pkg_media": f"{DECK}, part string, sha1 string, width int, height int",
    "pkg_comments": f"{DECK}, part string, author string, count int",
    "pkg_fonts": f"{DECK}, typeface string",
}
OUTCOMES = "rule string, category string, severity string, confidence string, outcome string, deck_id string, slide_index int, uid int, message string, measured string, expected string, signature string"
