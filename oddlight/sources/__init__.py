"""Manifests, packages, artifacts, images and the network stage."""
