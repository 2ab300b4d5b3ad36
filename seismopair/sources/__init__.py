"""Readers and writers of catalogs, stations and waveforms."""
