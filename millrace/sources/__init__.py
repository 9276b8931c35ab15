"""Readers: trees of files, lenient CSV, Label Studio and COCO annotations, text."""
