"""Schemas of the tables that flow between operators."""

from __future__ import annotations

LOCATION = "struct<file:string,line:int,column:int,text:string,label:string>"
OCCURRENCE = "struct<file:string,line:int,column:int,text:string,context:string>"
RAW_VIOLATION = f"message string, summary string, title string, severity string, file string, line int, column int, text string, code string, logical_id string, impact string, fix string, occurrences array<{OCCURRENCE}>, locations array<{LOCATION}>, dep_files array<string>, check_id string, step int, extras map<string,string>"
FILES = "path string, source string"
BLOCK = "file string, name string, start_line int, end_line int, loc int, body string, signature string"
DECLARATION = "kind string, name string, file_path string, line int, props array<struct<name:string,type:string,optional:boolean,readonly:boolean>>"
MARKER = "@corvane-ignore"
