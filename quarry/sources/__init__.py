"""Readers: post corpora, topic tables, project configuration, schema discovery."""
