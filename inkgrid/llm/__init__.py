"""Preparation of transcribed text for training language models.

The records are the library's own: a *text* is one row per uploaded document with
``doc_id`` and ``text`` (the joined text of its pages), ``lines`` of it are separated
by line feeds. Every operator keeps the other columns of its input.
"""
