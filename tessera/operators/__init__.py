"""Operators over spaces, units, graphs, trees and evaluation tables."""
