"""Readers of files, pages and PDF documents."""
