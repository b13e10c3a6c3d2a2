"""Trainers, configurations and sweeps."""
