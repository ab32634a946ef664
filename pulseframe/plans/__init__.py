"""Whole queries: conversion of an experiment, the inventory view, analysis planning."""
