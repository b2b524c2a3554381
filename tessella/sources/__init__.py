"""Readers, writers and dataset builders."""
