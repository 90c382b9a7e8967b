"""Decoders and encoders of the blobs in archives."""
