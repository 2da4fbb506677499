"""Subpackage of sieveline."""
