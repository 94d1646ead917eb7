"""Readers: folders of text files, and tables of documents."""
